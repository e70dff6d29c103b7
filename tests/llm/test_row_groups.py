"""Files of texts have small row groups, in stored tables and in the caller's own write."""

import glob
import random

import pyarrow.parquet as pq

from panelwright.llm.stored import small_batches, stored


def test_row_groups_of_texts_are_small(spark, tmp_path):
    drawn = random.Random(0)  # row groups are cut by their compressed size
    texts = spark.createDataFrame([(i, drawn.randbytes(40_000).hex()) for i in range(900)], "id int, text string")
    small_batches(spark)
    texts.coalesce(1).write.parquet(f"{tmp_path}/own")
    for path in (f"{tmp_path}/own", stored(texts.coalesce(1), "row-groups").stored_path):
        (file,) = glob.glob(f"{path.removeprefix('file:')}/*.parquet")
        meta = pq.ParquetFile(file).metadata
        assert meta.num_rows == 900
        sizes = [sum(meta.row_group(k).column(c).total_compressed_size for c in (0, 1)) for k in range(meta.num_row_groups)]
        assert max(sizes) <= 20 << 20, sizes
