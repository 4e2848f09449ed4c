import uuid

from pyspark.sql import functions as F

from semindex.functions import columns as C
from semindex.operators import filters, ignore
from semindex.sources import corpus


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_extensions(spark):
    assert values(spark, ["a/b.TS", ".gitignore", "a.", "x", "a.b/c", "d/e.tar.gz"], C.file_extension) == [".ts", "", ".", "", "", ".gz"]


def test_prefixes(spark):
    got = values(spark, [None, "", ".", "./", "src", "./src//a/", "/pkg", "a\\b", "a/../b", "../x", "a/./b/.."], C.normalize_prefix)
    assert got == [None, None, None, None, ["src"], ["src", "a"], ["pkg"], ["a", "b"], ["b"], ["..", "x"], ["a"]]


def test_prefix_is_by_whole_segments(spark):
    df = spark.createDataFrame([("src/a", "src"), ("srcx/a", "src"), ("src", "src/a"), ("x", None)], "p string, q string")
    got = df.select(C.under_prefix(C.path_segments("p"), C.normalize_prefix("q")).alias("y")).collect()
    assert [r.y for r in got] == [True, False, False, True]


def test_documentation_paths_and_queries(spark):
    assert values(spark, ["README.md", "docs/guide.txt", "docs\\overview.rst", "src/auth/password.ts", "docs/x.ts", "a/docs/x.ts", "a/readme"], C.is_documentation_path) == [True, True, True, False, False, True, True]
    assert values(spark, ["how to read the README", "doc of x", "explained", "where is the password check"], C.is_docs_query) == [True, True, False, False]


def test_identities(spark):
    namespace = uuid.UUID("f47ac10b-58cc-4372-a567-0e02b2c3d479")
    names = ["", "abc", "ä€😀", "x" * 300]
    assert values(spark, names, C.uuid5) == [str(uuid.uuid5(namespace, n)) for n in names]
    assert values(spark, ["/w/en"], C.collection_id)[0].startswith("ws-")


def test_trim_and_prefix(spark):
    assert values(spark, ["\u00a0 a b\u2003\n", "\ufeff", None], C.trimmed) == ["a b", "", None]
    assert values(spark, ["x", "q: x", "y" * 40_000], lambda c: C.apply_prefix(c, "q: ")) == ["q: x", "q: x", "y" * 40_000]


def test_ignore_rules(spark):
    rules = ignore.compile_ignore(["# note", "", "src/auth/", "*.log", "!keep.log", "/top", "a/**/z", "[xy]?.md", "foo\\*"])
    paths = ["src/auth", "src/auth/a.ts", "src/authx/a.ts", "x.log", "d/keep.log", "top", "d/top", "a/z", "a/b/c/z", "x1.md", "z1.md", "foo*", "fooz"]
    assert values(spark, paths, lambda c: ignore.is_ignored(c, rules)) == [True, True, False, True, False, True, False, True, True, True, False, True, False]
    df = spark.createDataFrame([("c", p) for p in paths], "collection_id string, file_path string")
    kept = {r.file_path for r in ignore.apply_ignore(df, rules).collect()}
    assert kept == {"src/authx/a.ts", "d/keep.log", "d/top", "z1.md", "fooz"}


def test_filters(spark):
    df = spark.createDataFrame([("a/node_modules/x.ts", "/r/a", 10), ("node_modules.ts", "/s/x.ts", 11), ("a/b.elm", "/r", 12), ("a.txt", "/r/a.py", 1)], "file_path string, resolved_path string, size_bytes long")
    assert [r.file_path for r in df.where(filters.not_default_ignored("file_path")).collect()] == ["node_modules.ts", "a/b.elm", "a.txt"]
    assert filters.filter_size(df, 11).count() == 3
    assert filters.filter_supported(df).count() == 4
    assert filters.filter_external(df, F.lit("/r"), False).count() == 3


def test_corpus_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("ä\nb")
    (tmp_path / "b.bin").write_text("x")
    (tmp_path / "c.py").write_text("y" * 100)
    rows = corpus.read_corpus(spark, str(tmp_path), max_bytes=50).collect()
    assert [(r.file_path, r.content, r.size_bytes) for r in rows] == [("src/a.ts", "ä\nb", 4)]


def test_manifest_json(spark, tmp_path):
    h = "ab" * 32
    df = spark.createDataFrame([("c", f'{{"src/main.ts": "{h}", "n": 3}}'), ("d", "not json")], "collection_id string, value string")
    assert [tuple(r) for r in corpus.parse_manifest(df).collect()] == [("c", "src/main.ts", h)]
    manifest = spark.createDataFrame([("c", "a", h), ("c", "b", h)], "collection_id string, file_path string, file_hash string")
    folder = f"{tmp_path}/m"
    corpus.save_version(manifest.limit(1), folder)
    corpus.save_version(manifest, folder)
    assert corpus.load_version(spark, folder).count() == 2


def test_trimmed_is_as_the_class_of_white_space_has_it(spark):
    texts = ["", " ", "\u3000a b\u2003\n", "\ufeff\t x\u00a0y \x0b\x0c\r", "\u200bz\u200b", "\u1680\u2028\u2029\u202f\u205f", "é\x85", "\x1c q"] + [chr(c) + "m" + chr(c) for c in range(0x2000, 0x2010)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    rows = df.select(C.trimmed("t").alias("got"), F.regexp_replace("t", rf"^{C.SPACE}+|{C.SPACE}+\z", "").alias("want"))
    assert all(r.got == r.want for r in rows.collect())
    assert "regexp" not in rows.select("got")._jdf.queryExecution().optimizedPlan().toString()
