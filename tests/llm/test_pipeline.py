"""The pipeline against the stages' plain versions, on a small corpus."""

import hashlib
import os
import random

import public_tokenizers

import corpus_pipeline
from semindex.llm import pieces
from tests.llm.test_text_ops import brute_removed


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    passage = text(50)
    rows = []
    for i in range(40):
        rows.append((i, text(rng.randint(80, 160)), "en", f"s{i % 3}"))
    rows.append((40, rows[0][1], "en", "s0"))  # an exact copy
    near = rows[1][1].split()
    near[5] = "other"
    rows.append((41, " ".join(near), "en", "s1"))  # a near copy
    rows += [(42, text(60) + " " + passage + " " + text(50), "en", "s2"), (43, text(70) + " " + passage + " " + text(40), "en", "s2")]
    rows += [(44, "too short", "en", "s0"), (45, "again " * 400, "en", "s1"), (46, None, "en", None), (47, "", None, "s1")]
    full = [(*r, len(r[1]) if r[1] else 0) for r in rows]
    folder = str(tmp_path)
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(os.path.join(folder, "documents.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    kept = [r for r in rows if r[0] < 40 or r[0] in (42, 43)]
    assert set(got) == {r[0] for r in kept}
    lattice = pieces.PieceLattice(public_tokenizers.path("piece_bpe_32k.model"))
    for r, (n, gone, digest) in zip(kept, brute_removed([r[1] for r in kept]), strict=True):
        left = lattice.decode(list(got[r[0]].ids))
        assert hashlib.sha256(" ".join(left.split()).encode()).hexdigest() == digest if gone else left == r[1]
        assert gone == (50 if r[0] in (42, 43) else 0)


def test_pipeline_on_an_empty_table_and_with_names_of_its_own(spark, tmp_path, odd_docs, no_docs):
    for name, docs, n in (("none", no_docs, 0), ("odd", odd_docs, None)):
        folder = str(tmp_path / name)
        docs.write.parquet(os.path.join(folder, "documents.parquet"))
        out = corpus_pipeline.run(spark, folder)
        rows = out.collect()
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "score", "nbest_scores"]
        assert len(rows) == n if n is not None else 1 in {r.doc_id for r in rows} and all(len(r.ids) == r.n_tokens for r in rows)
