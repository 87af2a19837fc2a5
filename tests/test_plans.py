"""Physical-plan properties the design relies on (checked with explain)."""

import io
import contextlib
import pathlib
import re

from pyspark.sql import functions as F

from corpuskit.operators import retrieval as R
from corpuskit.operators import store
from corpuskit.plans import search as S


def plan(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_topk_uses_partial_window_group_limit(spark, tables_small):
    scored = tables_small.events.select(F.col("user_id").alias("q"), "event_id", F.col("value").alias("s"))
    p = plan(R.top_k(scored, "q", "s", ["event_id"], 5))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_postings_shuffle_chunks_not_tokens(spark, tables_small):
    p = plan(R.postings(S.chunk_store(tables_small), S.KEYS), "simple")
    # one exchange: the chunk rows by chunk key; the aggregate over exploded
    # tokens reuses that partitioning
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    assert len(exchanges) == 1 and "doc_id" in exchanges[0] and "chunk_index" in exchanges[0]


def test_filename_filter_pushed_to_parquet(spark, tables_small, tmp_path):
    path = str(tmp_path / "store")
    store.conform(S.chunk_store(tables_small)).write.parquet(path)
    wanted = "src1/1.txt"
    df = spark.read.parquet(path).filter(F.col("source_filename") == wanted).select("chunk_index", "content")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(source_filename), EqualTo(source_filename,src1/1.txt)]" in p
    assert "ReadSchema: struct<content:string,source_filename:string,chunk_index:int>" in p


def test_chunking_prunes_columns(spark, tables_small):
    p = plan(S.chunk_store(tables_small))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all("lang" not in s and "n_chars" not in s for s in schemas)


def test_no_local_checkpoint_anywhere():
    root = pathlib.Path(__file__).resolve().parent.parent / "corpuskit"
    for f in root.rglob("*.py"):
        assert "localCheckpoint" not in f.read_text(), f
