"""What round 2's last findings changed."""

import collections
import math
import random

import numpy as np
import pyarrow as pa

from maskwright.llm import lm_hpyp, secret_forest


def test_the_forest_is_grown_from_plans_that_compile(spark):
    findings = secret_forest.labelled_findings(spark, 580)
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    before = held()  # other tests keep rows of theirs
    spark.conf.set("spark.sql.codegen.fallback", "false")  # a plan that can't be compiled fails, rather than being interpreted
    try:
        trees = secret_forest.fit_forest(spark, findings)
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(trees) == secret_forest.TREES and held() <= before
    rows = findings.collect()
    assert len(rows) == 580 and {r.after[0] for r in rows if r.before[-1] in "\"'"} == {"'", '"'} and {r.after[0] for r in rows if r.before[-1] not in "\"'"} == {" "}


def test_texts_are_cut_as_columns_into_the_same_tokens_and_pairs():
    odd = ["", None, " \t\n\v\f\r", "A", "a\x00B\x08C\x0eD\x1fE\x7f \x00", "ÉÀ ß\u00a0x\u2003Y \x85z", "  lead", "trail \n", "@[`{ AZaz", "", "x" * 3000, "Éa " * 700_000, None]
    train = [i % 3 != 1 for i in range(len(odd))]
    whole = pa.array(["before", *odd, "after"], pa.string()).slice(1, len(odd))
    want = [lm_hpyp.tokens((x or "").encode()) for x in odd]
    for texts, kept in ((whole, pa.array([True, *train]).slice(1)), (pa.chunked_array([whole.slice(0, 5), whole.slice(5, 0), whole.slice(5)]), pa.chunked_array([pa.array(train[:5]), pa.array(train[5:])]))):
        column, bounds = lm_hpyp._token_column(texts)
        assert lm_hpyp._listed_bytes(column) == [b"", *(w for x in want for w in x)] and np.diff(bounds).tolist() == [len(x) for x in want]
        every, held = collections.Counter(), collections.Counter()
        for x, k in zip(want, train, strict=True):
            every.update(zip([b"", *x[:-1]], x, strict=True))
            held.update(zip([b"", *x[:-1]], x, strict=True) if k else [])
        for places in (True, False):
            words, codes, n, pair, _ = lm_hpyp._paired(texts, kept, places)
            named = [(words[u], words[w]) for u, w in zip(codes // len(words), codes % len(words), strict=True)]
            assert dict(zip(named, n.tolist(), strict=True)) == {p: held[p] for p in every} and len(named) == len(every) and (np.diff(codes) > 0).all()
            assert pair is None if not places else [named[i] for i in pair.tolist()[: len(want[0]) + len(want[1])]] == [(b"", b"")] * 2
    for words in ([b""], [b"", b"a"], [b"a", b"", b"bc"], []):
        assert lm_hpyp._listed_bytes(lm_hpyp._split_words(b" ".join(words), len(words))) == words


def _cells(texts, train, size):
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts)) // size, pa.int32()), pa.array(texts, pa.string()), pa.array(train)], ["block", "text", "train"])
    return pa.Table.from_batches(list(lm_hpyp._block_cells(8)()(rows))).sort_by("cell").combine_chunks()


def test_what_training_has_once_is_told_to_blocks_without_rows_of_its_own():
    rng = random.Random(7)
    texts = [None, "", "a", "É a\x00b"] + [" ".join(f"w{int(rng.expovariate(0.002))}" for _ in range(200)) for _ in range(200)]
    train = [i % 3 > 0 for i in range(len(texts))]
    for size in (30, len(texts)):  # many blocks, one block
        table = _cells(texts, train, size)
        merged = [r for b in lm_hpyp._merged_cells(iter(table.to_batches(7))) for r in b.to_pylist()]
        rows = [r for b in lm_hpyp._settled(iter(table.to_batches(7))) for r in b.to_pylist()]
        kept = [{k: v for k, v in r.items() if k not in ("block", "keys")} for r in rows if r["kind"] in (0, 4)]
        assert kept == [r for r in merged if r["kind"] == 0 or r["kind"] == 4 and r["c"] > 1] and {r["kind"] for r in rows} <= {0, 4, 5, 6, 7}
        for new, old in ((5, 3), (6, 4)):
            told = collections.Counter((r["block"], k) for r in rows if r["kind"] == new for k in np.frombuffer(r["keys"], np.int64).tolist())
            assert told == collections.Counter((b, r["word"]) for r in merged if r["kind"] == old and r["c"] == 1 and len(r["blocks"]) > 4 for b in np.frombuffer(r["blocks"], "<i4").tolist())
            assert bool(told) == (size == 30)
        once = [r["text"] for r in merged if r["kind"] == 4 and r["c"] == 1]
        codes = collections.Counter(lm_hpyp.trigram_codes(once)[0].tolist())
        assert {r["word"]: r["c"] for r in rows if r["kind"] == 7} == {**codes, -1: len(once)}
        assert all(r["second"] == r["first"] == 1 for r in merged if r["kind"] == 4 and r["c"] == 1)  # one customer, one table


def test_scores_do_not_depend_on_how_documents_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, None if i == 5 else " ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(rng.randrange(40)))) for i in range(60)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), []
    for size in (4, 16, 2048):
        monkeypatch.setattr(lm_hpyp, "BLOCK_DOCS", size)
        got.append({r.doc_id: r for r in lm_hpyp.score_texts(docs).collect()})
    for i, _ in rows:
        a, *others = (x[i] for x in got)
        assert all(a[:5] == b[:5] and math.isclose(a.score, b.score, abs_tol=1e-9) and math.isclose(a.base_score, b.base_score, abs_tol=1e-9) for b in others)
