"""What round 2's findings changed."""

import collections
import random

import numpy as np
import pyarrow as pa

from maskwright.llm import html_extract, lm_hpyp, wavelet


def _blocks(texts, train, size):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n) // size, pa.int32()), pa.array(texts, pa.string()), pa.array(train)], ["block", "text", "train"])


def test_cells_hold_all_pairs_and_words_in_few_bytes():
    rng = random.Random(5)
    texts = [None, "", " \t", "a", "É a\x00b"] + [" ".join(f"w{int(rng.expovariate(0.002))}" for _ in range(300)) for _ in range(300)]
    train = [i % 3 > 0 for i in range(len(texts))]
    sent = [b for part in (slice(0, 130), slice(130, None)) for b in lm_hpyp._block_cells(8)()(_blocks(texts[part], train[part], 50))]  # block 0 and others come twice
    table = pa.Table.from_batches(sent).sort_by("cell").combine_chunks()
    pairs, words, blocks, spread = collections.Counter(), collections.Counter(), collections.defaultdict(list), 0
    for first, last in ((0, 130), (130, len(texts))):
        own = collections.defaultdict(set)
        for i in range(first, last):
            w = lm_hpyp.tokens((texts[i] or "").encode())
            both = list(zip([b"", *w[:-1]], w, strict=True))
            own[(i - first) // 50].update([*both, *w])
            pairs.update({p: 0 for p in both} if not train[i] else both)
            words.update({x: 0 for x in w} if not train[i] else w)
        for b, keys in own.items():
            spread += sum(isinstance(k, tuple) for k in keys)
            for k in keys:
                blocks[k].append(b)
    for size in (1, 7, 10_000):
        rows = [r for b in lm_hpyp._merged_cells(iter(table.to_batches(size))) for r in b.to_pylist()]
        h = dict(zip(words, lm_hpyp.signed(lm_hpyp._keys(list(words))).tolist(), strict=True))
        listed = lambda r: sorted(np.frombuffer(r["blocks"], "<i4").tolist())
        assert {(r["context"], r["word"]): (r["c"], listed(r)) for r in rows if r["kind"] == 0} == {(h[a], h[b]): (c, sorted(blocks[a, b])) for (a, b), c in pairs.items() if c > 1}
        once = [p for p, c in pairs.items() if c == 1 and len(blocks[p]) > 1]
        keys = lm_hpyp._pair_keys(np.array([h[a] for a, _ in once]), np.array([h[b] for _, b in once])).tolist()
        assert {r["word"]: listed(r) for r in rows if r["kind"] == 3} == {k: sorted(blocks[p]) for k, p in zip(keys, once, strict=True)}
        assert {r["text"]: (r["word"], r["c"], listed(r)) for r in rows if r["kind"] == 4} == {w: (h[w], c, sorted(blocks[w])) for w, c in words.items()}
        second, more = collections.Counter(), collections.Counter()
        for (_, b), c in pairs.items():
            second[h[b]] += c > 0
        for r in rows:
            if r["kind"] == 0:
                more[r["word"]] += r["more"]
        assert all(r["second"] - more[r["word"]] == second[r["word"]] for r in rows if r["kind"] == 4)
    assert sum(map(len, table.column("pairs").to_pylist())) < 17.5 * spread  # cells of a few pairs; 32 bytes as rows


def test_spelling_tables_give_the_same_probabilities():
    words = [b"", b"a", b"abc", b"abd", b"\xff\x00", b"zzzzzzzzzz"]
    codes, owner = lm_hpyp.trigram_codes(words[:4])
    fitted = lm_hpyp.Spelling.sampled(codes, np.arange(1.0, len(codes) + 1), lm_hpyp.Spelling.empty(), 1)
    for model in (lm_hpyp.Spelling.empty(), fitted):
        codes, owner = lm_hpyp.trigram_codes(words)
        assert (model.of(*lm_hpyp._column_trigrams(pa.array([b"x", *words], pa.binary())[1:]), len(words)) == np.exp(np.bincount(owner, np.log(model.probability(codes)), len(words)))).all()


def test_pages_are_scored_together_and_come_out_the_same(monkeypatch):
    rng = random.Random(3)
    pages = [None, "", "plain", "<p>", *(html_extract.synthetic_page(rng) for _ in range(60)), None, "<div><p>One.</p></div>"]
    model, calls = html_extract.trained(), []
    score = type(model).score
    monkeypatch.setattr(type(model), "score", lambda self, x: (calls.append(len(x)), score(self, x))[1])
    alone = [html_extract.main_text(p, model) for p in pages]
    calls.clear()
    assert list(html_extract.main_texts(iter(pages), model)) == alone and len(calls) == 1
    monkeypatch.setattr(html_extract, "SCORED_NODES", 100)
    calls.clear()
    assert list(html_extract.main_texts(iter(pages), model)) == alone and 1 < len(calls) < len(pages)
    assert list(html_extract.main_texts([], model)) == [] and alone[0] == alone[1] == ""


def test_wavelet_matrices_of_few_bits_use_half_the_width():
    rng = np.random.default_rng(2)
    for top in (1, 2, 300, 1 << 16, (1 << 16) + 1, (1 << 32) - 1):
        values = np.append(rng.integers(0, top, 70_000), top - 1).astype(np.uint32)
        matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(values).to_bytes())
        out = matrix.decode()
        assert out.dtype == np.uint32 and (out == values).all() and [matrix.access(i) for i in (0, 34_567, 70_000)] == values[[0, 34_567, 70_000]].tolist()
    assert (wavelet._width(16), wavelet._width(17)) == (np.uint16, np.uint32)


def test_distinct_hashes_as_numpy_finds_them():
    rng = np.random.default_rng(4)
    for n in (1, 2, 10_000):
        hashes = rng.integers(0, 1 << 64, 700, np.uint64)[rng.integers(0, 700, n)]
        key, one, inverse = wavelet._distinct(hashes)
        assert (key == np.unique(hashes)).all() and (hashes[one] == key).all() and (key[inverse] == hashes).all()


def test_values_are_sent_to_blocks_once():
    packed = lm_hpyp._packed(pa.array([[3, 5], [5], [], [0, 3, 5]], pa.list_(pa.int64())))
    rows = pa.RecordBatch.from_arrays([pa.array([10, 11, 12, 13]), pa.array([1.5, 2.0, 7.0, 3.0]), pa.array([None, 0.25, None, None]), pa.array([None, 4.0, None, None]), packed], ["key", "c", "p", "t", "blocks"])
    got = collections.defaultdict(list)
    for r in (r for b in lm_hpyp._sent(iter([rows, rows.slice(1, 1)])) for r in b.to_pylist()):
        value = [np.frombuffer(r[k], float).tolist() if r[k] is not None else None for k in ("c", "p", "t")]
        got[r["block"]].append((np.frombuffer(r["key"], np.int64).tolist(), *value))
    assert got == {0: [([13], [3.0], None, None)], 3: [([10, 13], [1.5, 3.0], None, None)], 5: [([10, 13], [1.5, 3.0], None, None), ([11, 11], [2.0] * 2, [0.25] * 2, [4.0] * 2)]}
    keys = np.array([7, -3, 9, 0])
    assert lm_hpyp._places(keys, np.array([0, 9, 7])).tolist() == [3, 2, 0]
