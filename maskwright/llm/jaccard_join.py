"""Exact Jaccard self-join of word-shingle sets by partitioning the universe (pigeonhole) with one-deletion segments.

Sets are put in size bands, each as wide as the threshold lets linked sizes differ, so that linked sets are in the same
or in neighbouring bands. The scheme of band i serves the pairs inside band i and those between bands i-1 and i. It hashes
the universe of shingles into segments: `zero` segments that must be equal and `one` segments that may differ by one
shingle. A set that differs from its partners in at most H shingles emits signatures of

* each one-deletion segment: its hash and the hashes after each deletion of one shingle;
* its H - 2 one + 1 largest `zero` segments, in an order that only their contents fix.

If no one-deletion segment of a linked pair agrees within a deletion, these use up 2 one differences, so that of the `zero`
segments all but H - 2 one are equal, and the first of the equal ones in the order of contents is among those that either
set emits. So linked sets share a signature, and segments of few shingles, which common passages make frequent, are left
out. `allocate` picks zero and one for each scheme by a cost model: signatures against expected false candidates.

Exact copies are one class (their sets' 128-bit fingerprints agree) and join once. Signatures travel packed, many to a row,
by hash ranges; a task keeps those that several classes have. In such a bucket the class with the smallest fingerprint is
the centre; the others are paired with it, and linked ones share a component. Only buckets that then still hold several
components go on: their mates are compared in blocks of BLOCK. Pairs are first compared by odd sketches, the parities of
the numbers of shingles in 1 to 2 cells a shingle: two sets differ in at least as many shingles as parities. Of the pairs
of a bucket first those of a spanning forest over components are verified, then all that are still between components:
every pair of a bucket is verified, ruled out or already connected. Verification counts the common shingles of the whole
sets. Classes are told apart by 128 bits, classes in signatures and links by 64.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, Scratch, combine, find_words, hash_words, map_batches, mix, narrowed, shuffle_partitions, signed, text_blocks, trim, without

#: Bucket mates that are compared at once.
BLOCK = 256
#: Signatures that a task holds before it hands them on, and that a range's task holds before it hands on full buckets.
HELD_OUT, HELD_IN = 1_000_000, 2_000_000

#: Pairs and components that a task remembers, so as not to hand them on again.
MOST_REMEMBERED = 1_000_000

_HASH_BITS = 52
_MASK = np.uint64((1 << _HASH_BITS) - 1)
#: The cost model's size of the corpus, and the share of two sets' shingles that agree by chance.
COST_SETS, COST_CHANCE = 1e9, 0.003
#: One-deletion segments that the cost model tries at most; shares of `zero` segments that aren't emitted.
MOST_ONE, SPARE = 8, (1.0, 1.1, 1.25, 1.4, 1.6, 2.0, 2.5, 3.0, 4.0)
#: An odd sketch has 2**6 to 2**15 cells; larger sets share cells, which rules out fewer pairs.
SKETCH_BITS = (6, 15)


def shingle_sets(block: Block, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a block's documents: hashes, sorted within each document, and the documents' bounds.

    Fewer words than a shingle's make one shingle; no words, no shingle. Hashes have 52 bits.
    """
    words = find_words(block)
    h = hash_words(block, words)
    counts, k = words.counts, words_per_shingle
    docs = words.docs
    n = len(h) - k + 1
    parts, owners = [], []
    if n > 0:
        whole = docs[:n] == docs[k - 1 :]
        s = combine(*(h[i : i + n] for i in range(k)))
        parts.append(s[whole])
        owners.append(docs[:n][whole])
    for m in range(1, k):  # documents of m words
        own = np.flatnonzero(counts == m)
        if len(own):
            at = words.bounds[own]
            parts.append(combine(*(h[at + i] for i in range(m))))
            owners.append(own)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(block) + 1, np.int64)
    key = np.concatenate(owners).astype(np.uint64) << np.uint64(_HASH_BITS) | np.concatenate(parts) & _MASK
    key = np.unique(key)
    bounds = np.searchsorted(key, np.arange(len(block) + 1, dtype=np.uint64) << np.uint64(_HASH_BITS))
    bounds[-1] = len(key)
    return key & _MASK, bounds


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; an empty set has 0."""
    out = []
    for salt in (1, 2):
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets * np.uint64(2 * salt + 1) + np.uint64(salt)), dtype=np.uint64)])
            out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1]


def band_of(sizes: np.ndarray, bands: np.ndarray) -> np.ndarray:
    return np.searchsorted(bands, sizes, side="right") - 1


@lru_cache(maxsize=16)
def bands_up_to(size: int, percent: int) -> tuple[int, ...]:
    """The smallest sizes of the bands; each ends at the largest size that its smallest can link with."""
    out = [1]
    while out[-1] <= size:
        out.append(out[-1] * 100 // percent + 1)
    return tuple(out)


def most_different(total, percent: int):
    """In how many shingles linked sets of `total` shingles together differ at most."""
    return total - 2 * -(-percent * total // (100 + percent))


@lru_cache(maxsize=4096)
def allocate(largest: int, percent: int) -> tuple[int, int]:
    """(zero, one): numbers of segments of the two kinds, cheapest for sets of up to `largest` shingles; (0, 0) where linked
    sets are equal."""
    most = max(most_different(2 * largest, percent), most_different(2 * largest - 1, percent))
    if most <= 0:
        return 0, 0
    best = (math.inf, 0, 0)
    for one in range(min(MOST_ONE, most // 2 + 1) + 1):
        emitted = max(0, most - 2 * one + 1)
        for zero in sorted({math.ceil(emitted * x) for x in SPARE}):
            sizes = _sizes(largest / (zero + one), zero + one)
            left, false = emitted, 0.0
            for s, p in reversed(sizes):  # the largest are emitted
                use = min(left, zero * p)
                left, false = left - use, false + use * COST_CHANCE**s
            false += max(0.0, left) + one * sum(p * (s + 1) * COST_CHANCE ** max(0, s - 1) for s, p in sizes)
            best = min(best, (emitted + one * (largest / (zero + one) + 1) + COST_SETS * false, zero, one))
    return best[1], best[2]


def _sizes(mean: float, segments: int) -> list[tuple[int, float]]:
    """Probabilities of a segment's sizes."""
    if segments == 1:
        return [(int(mean), 1.0)]
    out, p, s = [], math.exp(-mean), 0
    while s < mean + 10 * math.sqrt(mean) + 20:
        out.append((s, p))
        s += 1
        p *= mean / s
    return out


def signatures(sets: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets of a block, and the sets' places."""
    sizes = np.diff(bounds)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(sets):
        return none
    bands = np.array(bands_up_to(int(sizes.max()), percent))
    firsts = np.append(bands, bands[-1] * 100 // percent + 1)
    band = band_of(sizes, bands)
    owner, mixed = np.repeat(np.arange(len(sizes)), sizes), mix(sets)
    out, owners = [], []
    for step in (0, 1):
        scheme = band + step
        first = firsts[np.minimum(scheme, len(firsts) - 1)]
        largest = first * 100 // percent
        partner = np.minimum(largest, sizes * 100 // percent)
        most = np.maximum(most_different(sizes + partner, percent), most_different(sizes + partner - 1, percent))
        live = (sizes > 0) & (most > 0) & ((partner >= first) | (step == 0))
        plan = {s: allocate(int(r), percent) for s, r in set(zip(scheme[live].tolist(), largest[live].tolist(), strict=True))}
        zero, one = (np.array([plan.get(s, (0, 0))[k] for s in scheme.tolist()], np.int64) * live for k in (0, 1))
        m = zero + one
        base = np.concatenate([[0], np.cumsum(m)])
        keep = m[owner] > 0
        x, own = mixed[keep], owner[keep]
        if not len(x):
            continue
        with np.errstate(over="ignore"):
            at = ((mix(x + np.uint64(11)) >> np.uint64(32)) * m[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        seg, total = base[own] + at, int(base[-1])
        number = np.bincount(seg, minlength=total)
        low = np.bincount(seg, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(seg, (x >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        doc = np.repeat(np.arange(len(sizes)), m)
        place = np.arange(total) - base[doc]
        name = scheme[doc].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
        with np.errstate(over="ignore"):
            value = low + (high << np.uint64(32))
        full = combine(name, value, number.astype(np.uint64))
        exact = place < zero[doc]
        # of the segments that must be equal the largest, of equal sizes those with the smallest hashes
        z = np.flatnonzero(exact)
        key = doc[z].astype(np.uint64) << np.uint64(51) | (np.uint64(2047) - np.minimum(number[z], 2047).astype(np.uint64)) << np.uint64(40) | full[z] >> np.uint64(24)
        z = z[np.argsort(key, kind="stable")]
        rank = np.arange(len(z)) - np.concatenate([[0], np.cumsum(zero)])[doc[z]]
        z = z[rank < (most - 2 * one + 1)[doc[z]]]
        out.append(full[z])
        owners.append(doc[z])
        o = np.flatnonzero(~exact)
        if len(o):
            out.append(full[o])
            owners.append(doc[o])
            cut = ~exact[seg]
            s = seg[cut]
            with np.errstate(over="ignore"):
                out.append(combine(name[s], value[s] - x[cut], (number[s] - 1).astype(np.uint64)))
            owners.append(own[cut])
    return (np.concatenate(out), np.concatenate(owners)) if out else none


def odd_sketches(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set the parities of the numbers of its shingles in cells, as bits: a power of two of 1 to 2 cells a shingle."""
    sizes = np.diff(bounds)
    bits = np.clip(np.ceil(np.log2(np.maximum(sizes, 1))), *SKETCH_BITS).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(1 << bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        cell = (mix(mix(sets) + np.uint64(23)) & ((np.uint64(1) << bits[owner].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    raw = np.packbits((np.bincount(base[owner] + cell, minlength=int(base[-1])) & 1).astype(bool)).tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with so many words; the cells of a smaller sketch are unions of a larger one's."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, words), axis=1)


def _classes_of(shingle: int):
    def make():
        def step(batch):
            for block in text_blocks(batch.column("text")):
                sets, bounds = shingle_sets(block, shingle)
                a, b = fingerprints(sets, bounds)
                own = [batch.column(k).slice(block.first, len(block)) for k in ("id", "hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(bounds)), pa.array(signed(a)), pa.array(signed(b)), pa.array(odd_sketches(sets, bounds), pa.binary())], ["id", "hash", "n", "fp", "fp2", "sketch"])

        return step

    return make


def _packed_signatures(shingle: int, percent: int, ranges: int):
    """Rows of signatures of one range, sorted: their low 40 bits as 5 planes of bytes, the places of their classes in a list
    of fingerprints, and that list."""

    def pack(sig, fp):
        order = np.argsort(sig)
        sig, fp = sig[order], fp[order]
        cut = np.searchsorted(_range_of(sig, ranges), np.arange(ranges + 1))
        rows = []
        for r in np.flatnonzero(np.diff(cut)).tolist():
            s = sig[cut[r] : cut[r + 1]]
            own, place = np.unique(fp[cut[r] : cut[r + 1]], return_inverse=True)
            planes = np.ascontiguousarray((s << np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].T)
            rows.append((r, planes.tobytes(), place.astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes(), own.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["range", "sigs", "places", "fps"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                sets, bounds = shingle_sets(block, shingle)
                fp, _ = fingerprints(sets, bounds)
                once = np.zeros(len(block), bool)
                once[np.unique(fp, return_index=True)[1]] = True
                sig, owner = signatures(sets, bounds, percent)
                keep = once[owner]
                held.append((sig[keep], fp[owner[keep]]))
                count += int(keep.sum())
                if count >= HELD_OUT:
                    yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, count = [], 0
        if count:
            yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held = None
        trim()

    return run


def _range_of(sig: np.ndarray, ranges: int) -> np.ndarray:
    return ((sig >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _buckets(batches):
    """From packed signatures the buckets of several classes: sig (a name made of the classes), fp and the centre's fp."""
    held, count, centres = [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    for batch in batches:
        for r, sigs, places, fps in zip(*(batch.column(k).to_pylist() for k in ("range", "sigs", "places", "fps")), strict=True):
            own = np.frombuffer(fps, np.uint64)
            n = len(sigs) // 5
            place = np.frombuffer(places, np.uint16 if len(places) == 2 * n else np.uint32)
            raw = np.zeros((n, 8), np.uint8)
            raw[:, 3:] = np.frombuffer(sigs, np.uint8).reshape(5, n).T
            held.append((raw.view(">u8").ravel().astype(np.uint64) | np.uint64(r) << np.uint64(40), own[place]))
            count += n
            if count >= HELD_IN:
                # buckets that are full go on; of each signature one class stays, which is the centre from now on
                out, centres = _full_buckets(held, centres, True)
                held, count = [], 0
                yield out
    yield _full_buckets(held, centres, False)[0]
    held = centres = None
    trim()


def _full_buckets(held, centres, more: bool):
    sig, fp = (np.concatenate([x, *y]) for x, y in zip(centres, zip(*held, strict=True) if held else ((), ()), strict=True))
    old = np.arange(len(sig)) < len(centres[0])
    order = np.lexsort((fp, ~old, sig))
    sig, fp, old = sig[order], fp[order], old[order]
    same = np.concatenate([[False], sig[1:] == sig[:-1]])
    centre = fp[np.maximum.accumulate(np.where(same, 0, np.arange(len(sig))))]
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])]) & (~same | (fp != centre))
    sig, fp, centre, old = sig[keep], fp[keep], centre[keep], old[keep]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(sig)))
    several = np.repeat(size > 1, size)
    out_sig, out_fp, out_centre = sig[several], fp[several], centre[several]
    if len(out_sig) and not more and not len(centres[0]):
        # whole buckets: those with the same classes become one
        name = np.add.reduceat(mix(out_fp), np.concatenate([[0], np.cumsum(size[size > 1])[:-1]]))
        out_sig = np.repeat(combine(name, size[size > 1].astype(np.uint64)), size[size > 1])
        first = np.unique(out_sig, return_index=True)[1]
        whole = np.zeros(len(out_sig), bool)
        whole[first] = True
        begin = np.concatenate([[0], np.cumsum(size[size > 1])[:-1]])
        whole = np.repeat(whole[begin], size[size > 1])
        out_sig, out_fp, out_centre = out_sig[whole], out_fp[whole], out_centre[whole]
    batch = pa.RecordBatch.from_arrays([pa.array(signed(x)) for x in (out_sig, out_fp, out_centre)], ["sig", "fp", "centre"])
    return batch, (sig[starts], fp[starts])


def _sets_of(shingle: int):
    """fp and whole set (6 bytes of each hash) of those rows whose set has the fingerprint that is wanted of them. Of
    repeated rows, which the join before leaves side by side, one stays."""

    def make():
        last = [np.uint64(0)]

        def step(batch):
            wanted = batch.column("fp").to_numpy().view(np.uint64)
            for block in text_blocks(batch.column("text")):
                sets, bounds = shingle_sets(block, shingle)
                fp, _ = fingerprints(sets, bounds)
                raw = np.ascontiguousarray(sets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                first = np.zeros(len(fp), bool)
                first[np.unique(fp, return_index=True)[1]] = True
                own = np.flatnonzero((fp == wanted[block.first : block.first + len(block)]) & first & (fp != last[0]))
                last[0] = fp[-1]
                yield pa.RecordBatch.from_arrays([pa.array(signed(fp[own])), pa.array([raw[6 * bounds[i] : 6 * bounds[i + 1]] for i in own.tolist()], pa.binary())], ["fp", "shingles"])

        return step

    return make


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return np.sort(out.view("<u8").ravel())


def _near(percent: int, na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two tables of sketches may be linked."""
    words = min(a.shape[1], b.shape[1])
    differ = np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum(axis=1)
    return (differ <= most_different(na + nb, percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _sketches_near(percent: int):
    def make():
        def step(batch):
            na, nb = (batch.column(k).to_numpy() for k in ("na", "nb"))
            x, y = (batch.column(k).to_pylist() for k in ("xa", "xb"))
            ok = [bool(_near(percent, na[i : i + 1], nb[i : i + 1], np.frombuffer(x[i], np.uint64)[None], np.frombuffer(y[i], np.uint64)[None])[0]) for i in range(len(x))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return step

    return make


def _near_pairs(percent: int, forest: bool):
    """Rows sorted by (sig, lo, hi): pairs of each group between components that the sketches don't rule out.

    With `forest` only as many as connect the components of all groups of the task, each once in a task. Without it the rows
    have `sigs`, the sorted signatures of their groups, and of a pair's groups the one of the least signature hands it on.
    """

    root: dict[int, int] = {}
    seen: set[tuple[int, int]] = set()

    def top(z):
        while root.get(z, z) != z:
            root[z] = root.get(root[z], root[z])
            z = root[z]
        return z

    def compare(rows: dict[str, list], out: list[tuple[int, int]]) -> None:
        n, fp, label, part = (np.array(rows[k]) for k in ("n", "fp", "label", "part"))
        width = np.array([len(x) // 8 for x in rows["sketch"]])
        crossing = rows["lo"][0] != rows["hi"][0]
        kinds = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
        tables = {w: np.frombuffer(b"".join(rows["sketch"][i] for i in at), np.uint64).reshape(len(at), w) for w, at in kinds.items()}
        found = []
        for v, left in kinds.items():
            for w, right in kinds.items():
                if w < v:
                    continue
                x, y = tables[v], _folded(tables[w], v)
                for i, own in enumerate(left.tolist()):
                    js = np.arange(i + 1 if v == w else 0, len(right))
                    o = right[js]
                    ok = label[o] != label[own]
                    if crossing:
                        ok &= part[o] != part[own]
                    js, o = js[ok], o[ok]
                    if len(js):
                        near = _near(percent, n[o], np.full(len(o), n[own]), y[js], np.repeat(x[i : i + 1], len(js), axis=0))
                        found += [(abs(int(n[k]) - int(n[own])), fp[own], fp[k], label[own], label[k]) for k in o[near].tolist()]
        if forest:
            found.sort()
            if len(root) > MOST_REMEMBERED:
                root.clear()
            kept = []
            for f in found:
                u, v = top(f[3]), top(f[4])
                if u != v:
                    root[u] = v
                    kept.append(f)
            found = kept
        pairs = dict.fromkeys((int(min(f[1], f[2])), int(max(f[1], f[2]))) for f in found)
        if not forest:
            lower = {f: x[: np.searchsorted(x, rows["sig"][0])] for f, x in zip(fp.tolist(), rows["sigs"], strict=True)}
            out += [(a, b) for a, b in pairs if not np.intersect1d(lower[a], lower[b], assume_unique=True).size]
            return
        new = [p for p in pairs if p not in seen]
        if len(seen) > MOST_REMEMBERED:
            seen.clear()
        seen.update(new)
        out += new

    def run(batches):
        root.clear(), seen.clear()
        names = ("sig", "fp", "n", "label", "part", "lo", "hi", "sketch")
        held, key = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = {k: batch.column(k).to_pylist() for k in names}
            if not forest:
                lists = batch.column("sigs")
                flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                columns["sigs"] = [flat[a:b] for a, b in itertools.pairwise(ends.tolist())]
            keys = list(zip(columns["sig"], columns["lo"], columns["hi"], strict=True))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                piece = {k: x[at:end] for k, x in columns.items()}
                if keys[at] == key:
                    held = {k: held[k] + piece[k] for k in held}
                else:
                    if held:
                        compare(held, out)
                    held, key = piece, keys[at]
                at = end
            yield _pairs_batch(out)
        out = []
        if held:
            compare(held, out)
        yield _pairs_batch(out)

    return run


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


def _overlaps(percent: int):
    def make():
        def step(batch):
            linked, held = [], {}
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                raw = a.as_py()
                if held.get("raw") != raw:
                    held = {"raw": raw, "set": _unpacked(raw)}
                x, y = held["set"], _unpacked(b.as_py())
                at = np.searchsorted(x, y)
                common = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)) if len(x) else 0
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

        return step

    return make


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label): the smallest node that the edges (a, b) reach, for each node that has an edge.

    Each round hooks both ends' labels on the smaller one and then jumps to the label's label; the lineage is cut by a table,
    and the tables of the round before go.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = last = scratch.written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    if edges.isEmpty():
        return labels
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        # the old label's root hooks on what any of its members found
        roots = hooked.groupBy(F.col("label").alias("root")).agg(F.min("new").alias("to"))
        moved = hooked.join(roots, hooked.label == roots.root, "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("to", "new")).alias("label"))
        jump = moved.select(F.col("node").alias("via"), F.col("label").alias("next"))
        after = scratch.written(moved.join(jump, moved.label == jump.via, "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = after.select("node", "label")
        scratch.drop(last)
        last = after
        if after.where("old <> label").isEmpty():
            scratch.drop(edges)
            return labels


def _linked(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """id, hash, n and component_id of each row of docs (id, text, hash of the text)."""
    scratch = Scratch(docs.sparkSession)
    members = scratch.written(map_batches(docs, _classes_of(shingle), "id long, hash long, n long, fp long, fp2 long, sketch binary"))
    # a class is represented by a row that has its smallest id; rows without one come last
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("rep")
    classes = scratch.written(members.where("n > 0").groupBy("fp", "fp2", "n").agg(rep, F.first("sketch").alias("sketch")).select("fp", "fp2", "n", F.col("rep.id").alias("rep"), F.col("rep.hash").alias("hash"), "sketch"))

    ranges = shuffle_partitions(docs.sparkSession)
    packed = docs.select("text").mapInArrow(_packed_signatures(shingle, percent, ranges), "range int, sigs binary, places binary, fps binary")
    found = packed.repartitionById(ranges, F.col("range")).mapInArrow(_buckets, "sig long, fp long, centre long")
    mates = scratch.written(found.dropDuplicates(["sig", "fp"]))
    comp = _join_mates(docs, mates, classes, scratch, shingle, percent)
    labelled = classes.join(comp, "fp", "left").select("fp", "fp2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    return members.select("id", "hash", "n", "fp", "fp2").join(labelled, ["fp", "fp2", "n"], "left").select("id", "hash", "n", F.coalesce("component_id", "id").alias("component_id"))


def link_components(docs: DataFrame, shingle: int = 3, percent: int = 90, id_col: str = "doc_id") -> DataFrame:
    """For each document the number of its shingles and the smallest id among those it is linked with, by any number of links.

    docs: id_col (integer) and text; other columns are ignored. Null and empty texts, and those without words, have no
    shingles and are linked with nothing. Rows with the same id are documents of their own with equal ids; a component of
    rows without ids has none. Returns id_col, n_shingles, component_id.
    """
    return _linked(_keyed(docs, id_col), shingle, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"), _text_hash().alias("hash"))


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _join_mates(docs: DataFrame, mates: DataFrame, classes: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """fp and component_id of the classes that are linked with another."""
    spark = docs.sparkSession
    nodes = scratch.written(classes.join(mates.select("fp").distinct(), "fp", "left_semi").select("fp", "n", "rep", "hash", "sketch"))
    done = spark.createDataFrame([], "a long, b long, linked boolean")
    sets = spark.createDataFrame([], "fp long, shingles binary")
    labels = spark.createDataFrame([], "node long, label long")

    def side(x: str) -> DataFrame:
        return nodes.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"x{x}"))

    def checked(pairs: DataFrame) -> bool:
        """Verifies pairs (a, b), and renews sets, done and labels; false if there is none."""
        nonlocal sets, done, labels
        if pairs.isEmpty():
            return False
        own = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        wanted = scratch.written(nodes.join(own, "fp").join(sets.select("fp"), "fp", "left_anti").select("fp", F.col("rep").alias("id"), "hash"))
        texts = narrowed(docs, F.xxhash64("id", "hash"), wanted.select(F.xxhash64("id", "hash").alias("key"))).alias("d")
        # merge joins, so that the plan is the same whether or not one side is small
        held = texts.join(wanted.hint("merge").alias("w"), F.expr("d.id <=> w.id AND d.hash = w.hash")).select("w.fp", "d.text")
        sets = sets.unionByName(scratch.written(map_batches(held, _sets_of(shingle), "fp long, shingles binary")))
        left, right = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
        done = done.unionByName(scratch.written(map_batches(pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a"), _overlaps(percent), "a long, b long, linked boolean").distinct()))
        labels = components(done.where("linked"), scratch)
        return True

    stars = mates.where("fp <> centre").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()
    pairs = scratch.written(map_batches(stars.join(side("b"), "b").join(side("a"), "a"), _sketches_near(percent), "a long, b long"))
    checked(pairs)
    # a bucket of two classes has no pair but that with its centre
    larger = mates.groupBy("sig").agg(F.count("*").alias("k")).where("k > 2")
    several = mates.join(larger, "sig").select("sig", "fp")
    for forest in (True, False):
        now = several.join(labels, several.fp == labels.node, "left").select("sig", "fp", F.coalesce("label", "fp").alias("label"))
        open_ = now.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("sig", F.ceil(F.col("k") / BLOCK).alias("parts"))
        live, own = now.join(open_, "sig"), nodes.select("fp", "n", "sketch")
        if not forest:
            own = own.join(live.groupBy("fp").agg(F.sort_array(F.collect_set("sig")).alias("sigs")), "fp")
        dealt = live.withColumn("part", F.pmod(F.xxhash64("fp", "sig"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("sig", "fp", "label", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).join(own, "fp")
        dealt = dealt.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "part", "fp")
        new = dealt.mapInArrow(_near_pairs(percent, forest), "a long, b long").distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")
        if not checked(scratch.written(new)):
            break
    ids = labels.join(nodes.select(F.col("fp").alias("node"), "rep"), "node")
    least = ids.groupBy("label").agg(F.min("rep").alias("component_id"))
    return ids.join(least, "label").select(F.col("node").alias("fp"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; rows that share this id and its component all
    stay. Documents with a null doc_id stay. The columns stay."""
    keyed = docs.where("doc_id IS NOT NULL")
    gone = Scratch(docs.sparkSession).written(_linked(_keyed(keyed, "doc_id"), shingle, percent).where("component_id <> id").select("id", "hash").distinct())
    return without(docs, F.xxhash64(F.col("doc_id").cast("long"), _text_hash()), gone.select(F.xxhash64("id", "hash").alias("key")))
