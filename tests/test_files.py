"""binaryFile scan -> MIME converters -> cleaned text."""

from corpuskit.sources.files import read_corpus


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one  two\n\n\nthree")
    (tmp_path / "b.html").write_text("<html><head><title>t</title></head><body><p>Hello &amp; bye</p>"
                                     "<script>x()</script></body></html>")
    (tmp_path / "c.md").write_text("# Title\n\nSome **bold** [link](http://x)")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "e.bin").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[-1]: (r.converter, r.text) for r in read_corpus(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("text", "one two\nthree")
    assert got["b.html"] == ("html", "Hello & bye")
    assert got["c.md"] == ("markdown", "Title\nSome bold link")
    assert got["d.pdf"] == ("pdf", None)
    assert got["e.bin"] == ("text", None)


def test_replace_files_on_disk(spark, tmp_path):
    from pyspark.sql import functions as F
    from corpuskit.operators import store

    def chunks(files, tag):
        rows = [(f"{tag} {f} {i}", f, i, n) for f, n in files for i in range(n)]
        return spark.createDataFrame(rows, "content string, source_filename string, chunk_index int, total_chunks int")

    path = str(tmp_path / "store")
    store.replace_files(spark, path, chunks([("a.txt", 3), ("b.txt", 2), ("c.txt", 1)], "v1"), bucket_rows=3)
    store.replace_files(spark, path, chunks([("b.txt", 4)], "v2"), bucket_rows=3)
    got = store.chunk_table(spark, path).read().groupBy("source_filename").agg(
        F.count("*").alias("n"), F.max(F.split("content", " ")[0]).alias("tag")).collect()
    assert {(r.source_filename, r.n, r.tag) for r in got} == {("a.txt", 3, "v1"), ("b.txt", 4, "v2"), ("c.txt", 1, "v1")}
