"""Near-duplicate texts by meet-in-the-middle ball hashing.

A text is the set of its word shingles, hashed to 64 bits and laid on a ring
in hash order. A *fingerprint* is a shingle (the anchor) with the shingles
that follow it on the ring. Two fingerprints with the same anchor are within
radius 2 of each other if each becomes the same word of RUN shingles when at
most one of its own followers is left out. So every fingerprint emits the ball
of half that radius, namely itself and each form with one follower left out,
and two texts meet on a shared variant without being compared before.

Completeness. On the ring of the union of two sets with Jaccard similarity of
at least 0.7 the stretches of common shingles between two different ones hold
7/3 of them on average, so two neighbouring stretches hold four somewhere:
with every shingle as an anchor some fingerprint of both meets always. Up to
`anchors` shingles all of them are anchors. Above, the first shingle of each
of `anchors` equal arcs is one; each arc of a pair at 0.7 meets with
probability 0.52, so a pair exactly at the threshold is lost with probability
0.48 ** anchors (0.0002 for 12), one at 0.75 with 0.39 ** anchors (0.00001).
`anchors=None` makes all shingles anchors, for no loss at any length. Sets of
less than ten shingles are also met by leaving out up to three tenths of the
set, which is exact.

Shuffle. All variants of a fingerprint have its anchor, and the anchor alone
decides the bucket in which they meet, so a text's key goes there once with all
of them, as bytes of a fixed length that neither more partitions nor smaller
blocks make longer. Texts of variants that up to FEW share are paired there.
Of larger groups the texts come with their sketches first, and only pairs that
these leave possible are written, so what is written grows as the groups' texts
and not as their pairs.

Hot variants. A boilerplate under a third of the texts gives variants that as
many texts share. A task that meets a variant in more than LOCAL of its texts
says so once and of further texts sends the key alone, spread evenly, so no
group of the shuffle holds more than LOCAL rows of each task. The texts of
variants that more than HOT texts share are paired by an exact prefix filter.

Equal texts share a key and are one text throughout. Keys are 64-bit hashes;
where two texts with the same hash differ by a second one, the second is the
key, so no two different texts are taken for equal.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions.words import split_words
from corpuskiln.operators.components import connected_components
from corpuskiln.session import durable

RUN = 4
SMALL = 10
SKETCH = 256
ANCHORS = 12
#: Variants that more texts share than this are refined by an exact prefix filter.
HOT = 256
#: Variants that up to this many texts share are paired where they meet, those of more with sketches at hand.
FEW = 8
#: Texts of a task that may meet on a variant; those of a batch from which on they are counted.
LOCAL, WATCHED = 64, 4
#: Copies of a text that are paired in one piece; pairs of more copies are split into blocks.
COPIES = 1_000
SALTS = 16
#: Texts with equal hashes that are told apart on the driver (expected: less than one in 10^9 texts).
MOST_COLLISIONS = 10_000
#: Keys of candidates are broadcast up to this many (8 bytes each), else joined by a shuffle.
BROADCAST_KEYS = 500_000

_BITS = np.uint64(48)
_TEXTS = 65_536
#: Bits of an anchor that name its bucket, and of a variant that are kept within it.
_BUCKET, _KEPT = np.uint64(12), np.uint64(48)
#: What a row of bytes holds: keys with all forms of a fingerprint, keys with one form, keys of common variants, forms that are common.
_FULL, _ONE, _COMMON, _TOLD = range(4)
#: Bytes of whole buckets that are worked on at a time.
_WORK = 4_000_000
_SKETCH = [f"s{i}" for i in range(SKETCH // 64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 1_000_000:
            self[word] = value
        return value


def ring(words: list[list[bytes]], size: int, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of at most 65,536 texts in (text, hash) order, and the texts' numbers."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(words), dtype=np.uint64), lengths)
    if len(flat) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = flat[: len(flat) - size + 1]
    for k in range(1, size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - size + 1 + k]
    inside = owner[: len(value)] == owner[size - 1 :]
    value, owner = _mix(value[inside]), owner[: len(inside)][inside]
    packed = (owner << _BITS) | (value >> (np.uint64(64) - _BITS))
    packed.sort()
    if len(packed):
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    return packed & ((np.uint64(1) << _BITS) - np.uint64(1)), (packed >> _BITS).astype(np.int64)


def text_hashes(words: list[list[bytes]], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each text's word sequence."""
    return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed) for w in words], dtype=np.uint64).view(np.int64)


def text_keys(words: list[list[bytes]], collided: np.ndarray) -> np.ndarray:
    """A key of each text's word sequence: its hash, or a second one where the first is that of several texts."""
    keys = text_hashes(words)
    again = np.flatnonzero(np.isin(keys, collided)) if len(collided) else ()
    if len(again):
        keys[again] = text_hashes([words[i] for i in again], 1)
    return keys


def ball(value: np.ndarray, owner: np.ndarray, anchors: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(variants, text number) of all fingerprints' half balls, RUN variants of each, and of small sets, one in a row."""
    if not len(value):
        return [(np.empty((0, n), np.uint64), np.empty(0, np.int64)) for n in (RUN, 1)]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    counts = np.diff(np.r_[starts, len(value)])
    start, count = np.repeat(starts, counts), np.repeat(counts, counts)
    place = np.arange(len(value)) - start
    chosen = count > RUN + 1
    if anchors is not None:
        arc = ((value >> np.uint64(16)) * np.uint64(anchors)) >> np.uint64(32)
        first = np.r_[True, (arc[1:] != arc[:-1]) | (owner[1:] != owner[:-1])]
        chosen &= first | (count <= anchors)
    at = np.flatnonzero(chosen)
    follow = [value[start[at] + (place[at] + j) % count[at]] for j in range(1, RUN + 1)]
    anchor, forms = _mix(value[at]), np.empty((len(at), RUN), np.uint64)
    for skip in range(RUN):
        v = anchor
        for j in [j for j in range(RUN) if j != skip]:
            v = _mix(v * np.uint64(3) + follow[j])
        forms[:, skip] = v
    out_v, out_o = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for s, n in zip(starts[counts <= SMALL], counts[counts <= SMALL]):
        members = _mix(value[s : s + n])
        whole = members.sum(dtype=np.uint64)
        for left_out in range(3 * int(n) // 10 + 1):
            v = [whole - members[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), left_out)]
            out_v.append(_mix(np.array(v, dtype=np.uint64) + np.uint64(1)))
            out_o.append(np.full(len(v), owner[s]))
    small = np.concatenate(out_v)
    return [(_named(forms, anchor[:, None]), owner[at]), (_named(small, small)[:, None], np.concatenate(out_o))]


def _named(forms: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The forms with the bucket of their place in front, as 60-bit variants."""
    return ((_mix(place) >> (np.uint64(64) - _BUCKET)) << _KEPT) | (forms >> (np.uint64(64) - _KEPT))


def sketches(value: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Of each text, the parities of its shingles in SKETCH buckets, as 64-bit words.

    Two texts' sketches differ in at most as many bits as their sets differ in
    elements, so a pair whose sketches differ in more than its similarity
    allows is safely no link.
    """
    bucket = (value >> np.uint64(40)) % np.uint64(SKETCH)
    parity = np.bincount(owner * SKETCH + bucket.astype(np.int64), minlength=count * SKETCH) & 1
    return np.packbits(parity.astype(np.uint8).reshape(count, SKETCH // 64, 64), axis=2).view(np.int64).reshape(count, SKETCH // 64)


def _long_enough(column: pa.Array, size: int) -> tuple[np.ndarray, list[list[bytes]]]:
    words = split_words(column.to_pylist())
    at = np.array([i for i, w in enumerate(words) if len(w) >= size], dtype=np.int64)
    return at, [words[i] for i in at]


def _keyer(size: int):
    """All rows with both hashes of their texts, the sizes of their sets and sketches; nulls where a text is null or too short."""

    def key(batches):
        hashes = _WordHashes()
        for batch in batches:
            at, words = _long_enough(batch.column(2), size)
            rest = np.setdiff1d(np.arange(batch.num_rows), at)
            if len(rest):
                kept, none = batch.take(pa.array(rest)), pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *[none] * (3 + len(_SKETCH))], names=["_id", "_version", "key", "second", "n", *_SKETCH])
            for i in range(0, len(words), _TEXTS):
                part = words[i : i + _TEXTS]
                value, owner = ring(part, size, hashes)
                kept = batch.take(pa.array(at[i : i + _TEXTS]))
                sketch = [pa.array(c) for c in sketches(value, owner, len(part)).T.copy()]
                sizes = pa.array(np.bincount(owner, minlength=len(part)))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(text_hashes(part)), pa.array(text_hashes(part, 1)), sizes, *sketch], names=["_id", "_version", "key", "second", "n", *_SKETCH])

    return key


def _bytes(kind: int, variants: np.ndarray, keys: np.ndarray | None) -> pa.RecordBatch:
    """bucket, kind, rows: of each row of variants its key, if any, and the variants' 6 bytes below the bucket's."""
    bucket = (variants[:, 0] >> _KEPT).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    n, forms, kept = *variants.shape, int(_KEPT) // 8
    low = np.ascontiguousarray(variants[order], "<u8").view(np.uint8).reshape(n, forms, 8)[:, :, :kept].reshape(n, forms * kept)
    parts = [low] if keys is None else [np.ascontiguousarray(keys[order], "<i8").view(np.uint8).reshape(n, 8), low]
    data, bucket = np.concatenate(parts, axis=1), bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    ends = (np.r_[starts, len(bucket)] * data.shape[1]).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(starts), kind, np.int8)), rows], names=["bucket", "kind", "rows"])


def _emitter(size: int, anchors: int | None, collided: np.ndarray, local: int):
    """bucket, kind, rows: texts under their variants, texts of variants too common in the task (spread by key), the task's word that these are."""

    def emit(batches):
        hashes, seen, said = _WordHashes(), Counter(), set()
        for batch in batches:
            _, words = _long_enough(batch.column(0), size)
            keys, at = np.unique(text_keys(words, collided), return_index=True)
            words = [words[i] for i in at]
            for i in range(0, len(words), _TEXTS):
                found = [(v, keys[i + o]) for v, o in ball(*ring(words[i : i + _TEXTS], size, hashes), anchors)]
                values, counts = np.unique(np.concatenate([v.ravel() for v, _ in found]), return_counts=True)
                often = counts >= WATCHED
                for v, n in zip(values[often].tolist(), counts[often].tolist()):
                    seen[v] += n
                hot = np.array([v for v in values[often].tolist() if seen[v] > local], dtype=np.uint64)
                heat = [np.isin(v, hot) for v, _ in found]
                fresh = [v for v in hot.tolist() if v not in said]
                said.update(fresh)
                for kind, (v, key), h in zip((_FULL, _ONE), found, heat):
                    cool = ~h.any(axis=1)
                    yield _bytes(kind, v[cool], key[cool])
                    yield _bytes(_ONE, v[~h & ~cool[:, None]][:, None], np.repeat(key, (~h & ~cool[:, None]).sum(axis=1)))
                common = np.unique(np.concatenate([key[h.any(axis=1)] for (_, key), h in zip(found, heat)]))
                yield _bytes(_COMMON, _named(common.view(np.uint64), common.view(np.uint64))[:, None], common)
                yield _bytes(_TOLD, np.array(fresh, np.uint64)[:, None], None)

    return emit


def _read(kept: list[tuple[int, int, bytes]], kind: int, forms: int, keyed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(variants, keys), one by one, of the rows of bytes of a kind."""
    rows, width = [(b, r) for b, k, r in kept if k == kind], 8 * keyed + forms * int(_KEPT) // 8
    data = np.frombuffer(b"".join(r for _, r in rows), np.uint8).reshape(-1, width)
    bucket = np.repeat(np.array([b for b, _ in rows], np.uint64), np.array([len(r) // width for _, r in rows], np.int64))
    padded = np.zeros((len(data), forms, 8), np.uint8)
    padded[:, :, : int(_KEPT) // 8] = data[:, 8 * keyed :].reshape(len(data), forms, int(_KEPT) // 8)
    variants = padded.view("<u8")[:, :, 0].astype(np.uint64) | (bucket << _KEPT)[:, None]
    keys = np.ascontiguousarray(data[:, :8]).view("<i8")[:, 0].astype(np.int64) if keyed else np.empty(0, np.int64)
    return variants.ravel().view(np.int64), np.repeat(keys, forms)


def _after(group: np.ndarray):
    """Places i and i + d of rows of the same group, for one d after the other; group is sorted."""
    i = np.arange(len(group))
    for d in range(1, len(group)):
        i = i[i + d < len(group)]
        i = i[group[i] == group[i + d]]
        if not len(i):
            return
        yield i, i + d


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of two columns, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return a[new], b[new]


def _meeter(hot: int):
    """variant, key_a, key_b from rows of bytes in the order of buckets: a pair without variant, a text under a variant of more than FEW, or the key alone of one under a hot variant."""

    def met(kept):
        (v, k), (v1, k1) = _read(kept, _FULL, RUN, True), _read(kept, _ONE, 1, True)
        told, spread = np.unique(_read(kept, _TOLD, 1, False)[0]), _read(kept, _COMMON, 1, True)[1]
        v, k = np.r_[v, v1], np.r_[k, k1]
        order = np.argsort(v)
        v, k = v[order], k[order]
        same = v[1:] == v[:-1]
        may = (np.r_[False, same] | np.r_[same, False])[: len(v)]
        if len(told):
            may |= np.isin(v, told)
        v, k = _distinct(v[may], k[may])
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]][: len(v)])
        sizes = np.diff(np.r_[starts, len(v)])
        warm = (sizes > hot) | np.isin(v[starts], told)
        # several variants of a fingerprint mostly have the same texts
        mark = np.add.reduceat(_mix(k.view(np.uint64)), starts) if len(starts) else np.empty(0, np.uint64)
        first = np.zeros(len(starts), bool)
        first[np.unique(np.stack([mark, sizes.astype(np.uint64)], axis=1), axis=0, return_index=True)[1]] = True
        few, rest = (np.repeat(x, sizes) for x in (~warm & first & (sizes <= FEW), ~warm & first & (sizes > FEW)))
        a, b = zip(*_after(v[few]), strict=True) if few.any() and (sizes[first & ~warm & (sizes <= FEW)] > 1).any() else ((), ())
        none = np.empty(0, np.int64)
        a, b = _distinct(k[few][np.concatenate([none, *a])], k[few][np.concatenate([none, *b])])
        alone = np.unique(np.r_[spread, k[np.repeat(warm, sizes)]])
        for columns in ((pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)), (pa.array(v[rest]), pa.array(k[rest]), pa.nulls(int(rest.sum()), pa.int64())), (pa.nulls(len(alone), pa.int64()), pa.array(alone), pa.nulls(len(alone), pa.int64()))):
            yield pa.RecordBatch.from_arrays(list(columns), names=["variant", "key_a", "key_b"])

    def meet(batches):
        kept, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held > _WORK and row[0] != kept[-1][0]:
                    yield from met(kept)
                    kept, held = [], 0
                kept.append(row)
                held += len(row[2])
        if kept:
            yield from met(kept)

    return meet


def _pairer(tenths: int):
    """key_a, key_b: the pairs of texts of the same variant whose sizes and sketches allow the similarity, from rows in the order of variants."""

    def pair(batches):
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                rows = rows if rest is None else np.concatenate([rest, rows])
                if not len(rows):
                    continue
                end = np.searchsorted(rows[:, 0], rows[-1, 0])
                rows, rest = rows[:end], rows[end:]
            elif rest is None:
                return
            else:
                rows = rest
            found = [np.empty((0, 2), np.int64)]
            for i, j in _after(rows[:, 0]):
                n, m = rows[i, 2], rows[j, 2]
                fit = (n * 10 >= m * tenths) & (m * 10 >= n * tenths)
                i, j = i[fit], j[fit]
                apart = np.bitwise_count((rows[i, 3:] ^ rows[j, 3:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                fit = apart * (10 + tenths) <= (rows[i, 2] + rows[j, 2]) * (10 - tenths)
                found.append(np.stack([rows[i[fit], 1], rows[j[fit], 1]], axis=1))
            a, b = np.concatenate(found).T
            a, b = _distinct(np.minimum(a, b), np.maximum(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["key_a", "key_b"])

    return pair


def _text_keyer(size: int, collided: np.ndarray):
    def key(batches):
        for batch in batches:
            at, words = _long_enough(batch.column(0), size)
            keys, first = np.unique(text_keys(words, collided), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(at[first]))], names=["key", "_text"])

    return key


def _ringer(size: int):
    def emit(batches):
        hashes = _WordHashes()
        for batch in batches:
            words = split_words(batch.column(1).to_pylist())
            for i in range(0, len(words), _TEXTS):
                value, owner = ring(words[i : i + _TEXTS], size, hashes)
                ends = np.searchsorted(owner, np.arange(len(words[i : i + _TEXTS]) + 1)).astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, _TEXTS), parts], names=["key", "parts"])

    return emit


def _rings(texts: DataFrame, keys: DataFrame, size: int, collided: np.ndarray) -> DataFrame:
    """key, parts (48-bit hashes of its shingles) of the wanted texts."""
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    wanted = texts.mapInArrow(_text_keyer(size, collided), "key long, _text string").join(keys, "key", "left_semi")
    return wanted.mapInArrow(_ringer(size), "key long, parts array<long>").groupBy("key").agg(F.first("parts").alias("parts"))


def _close(pairs: DataFrame, sketched: DataFrame, tenths: int) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity."""
    a = sketched.select(F.col("key").alias("key_a"), F.col("n").alias("n_a"), *[F.col(c).alias(f"{c}_a") for c in _SKETCH])
    b = sketched.select(F.col("key").alias("key_b"), F.col("n").alias("n_b"), *[F.col(c).alias(f"{c}_b") for c in _SKETCH])
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH), F.lit(0))
    return (
        pairs.join(a, "key_a")
        .join(b, "key_b")
        .where((F.col("n_a") * 10 >= F.col("n_b") * tenths) & (F.col("n_b") * 10 >= F.col("n_a") * tenths))
        .where(apart * (10 + tenths) <= (F.col("n_a") + F.col("n_b")) * (10 - tenths))
        .select("key_a", "key_b")
    )


def _hot_pairs(hot: DataFrame, texts: DataFrame, size: int, tenths: int, collided: np.ndarray) -> DataFrame:
    """Exact candidate pairs among the texts of too common variants: prefix filtering, rarest shingle first.

    Texts of similarity t share one of their n - ceil(t n) + 1 first shingles
    in any common order. The order by frequency among these very texts puts
    what they all share last.
    """
    parts = _rings(texts, durable(hot.select("key").distinct()), size, collided).select("key", F.explode("parts").alias("part"))
    common = parts.groupBy("part").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("key")
    ranked = (
        parts.join(common, "part")
        .withColumn("rank", F.row_number().over(inside.orderBy("n", "part")))
        .withColumn("size", F.count("*").over(inside))
        .where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * tenths / 10) + 1)
        .where("n > 1")
    )
    left = ranked.select("part", F.col("key").alias("key_a"), F.col("size").alias("size_a"), F.col("rank").alias("rank_a"))
    right = ranked.select("part", F.col("key").alias("key_b"), F.col("size").alias("size_b"), F.col("rank").alias("rank_b"))
    most = F.least(F.col("size_a") - F.col("rank_a"), F.col("size_b") - F.col("rank_b")) + 1  # common ones, if this is the first
    return (
        left.join(right, "part")
        .where("key_a < key_b")
        .where((F.col("size_a") * 10 >= F.col("size_b") * tenths) & (F.col("size_b") * 10 >= F.col("size_a") * tenths))
        .where(most * (10 + tenths) >= (F.col("size_a") + F.col("size_b")) * tenths)
        .select("key_a", "key_b")
    )


def linked_texts(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    version_col: str | None = None,
    size: int = 5,
    tenths: int = 8,
    anchors: int | None = ANCHORS,
    hot: int = HOT,
    local: int = LOCAL,
) -> tuple[DataFrame, DataFrame]:
    """(links, members): links(key_a, key_b, similarity) between different texts whose shingle sets
    have a Jaccard similarity of at least tenths/10 (7 or more), members(_id, key) the ids of each text.

    Null ids are left out. Of several rows of an id the one with the greatest
    version (then text hash) counts; if its text is null or has less than
    `size` words, the id is left out. Equal texts share a key. An empty table
    gives empty results.
    """
    if tenths < 7:
        raise ValueError("the fingerprints' radius covers similarities of 0.7 and more")
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("_text")).where("_text is not null")
    versions = F.col(version_col) if version_col else F.lit(0)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), versions.alias("_version"), F.col(text_col).alias("_text"))
    kinds = dict(rows.dtypes)
    hashed = durable(rows.mapInArrow(_keyer(size), f"_id {kinds['_id']}, _version {kinds['_version']}, key long, second long, n long, " + ", ".join(f"{c} long" for c in _SKETCH)))
    twice = hashed.where("key is not null").groupBy("key").agg(F.min("second").alias("_a"), F.max("second").alias("_b")).where("_a <> _b").select("key").limit(MOST_COLLISIONS + 1).collect()
    if len(twice) > MOST_COLLISIONS:
        raise RuntimeError("too many texts with equal hashes")
    collided = np.array([r[0] for r in twice], dtype=np.int64)
    keyed = hashed.withColumn("key", F.when(F.col("key").isin(collided.tolist()), F.col("second")).otherwise(F.col("key"))) if len(collided) else hashed
    newest = keyed.groupBy("_id").agg(F.max(F.struct("_version", "key"))["key"].alias("key"))
    members = newest.where("key is not null")
    sketched = keyed.where("key is not null").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", *_SKETCH)])
    balls = texts.mapInArrow(_emitter(size, anchors, collided, local), "bucket int, kind tinyint, rows binary")
    shared = durable(balls.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meeter(hot), "variant long, key_a long, key_b long"))
    grouped = shared.where("variant is not null").select("variant", F.col("key_a").alias("key")).join(sketched, "key")
    grouped = grouped.select("variant", "key", "n", *_SKETCH).repartition("variant").sortWithinPartitions("variant")
    met = shared.where("key_b is not null").select("key_a", "key_b").unionByName(grouped.mapInArrow(_pairer(tenths), "key_a long, key_b long"))
    many = shared.where("variant is null and key_b is null").select(F.col("key_a").alias("key"))
    if not many.isEmpty():
        met = met.unionByName(_hot_pairs(many, texts, size, tenths, collided))
    pairs = durable(_close(met.distinct(), sketched, tenths))
    keys = pairs.select(F.col("key_a").alias("key")).union(pairs.select("key_b")).distinct()
    sets = durable(_rings(texts, durable(keys), size, collided))
    a = sets.select(F.col("key").alias("key_a"), F.col("parts").alias("parts_a"))
    b = sets.select(F.col("key").alias("key_b"), F.col("parts").alias("parts_b"))
    common = F.size(F.array_intersect("parts_a", "parts_b"))
    links = (
        pairs.join(a, "key_a")
        .join(b, "key_b")
        .select("key_a", "key_b", common.alias("_common"), (F.size("parts_a") + F.size("parts_b")).alias("_both"))
        .where(F.col("_common") * 10 >= (F.col("_both") - F.col("_common")) * tenths)
        .select("key_a", "key_b", (F.col("_common") / (F.col("_both") - F.col("_common"))).alias("similarity"))
    )
    return links, members


def copies(members: DataFrame, most: int = COPIES) -> DataFrame:
    """_a < _b: every pair of ids of the same text, for members(_id, key).

    Up to `most` copies are paired on their key. More are dealt to blocks, and
    each pair of blocks is a key of its own, so no task pairs more than two blocks.
    """
    sizes = durable(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    spread = sizes.withColumn("_salt", F.explode(F.when(F.col("n") > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    few = members.join(spread.where("_salt = -1").select("key"), "key")
    a, b = few.select("key", F.col("_id").alias("_a")), few.select("key", F.col("_id").alias("_b"))
    paired = a.join(b, "key").where("_a < _b").select("_a", "_b")
    hot = spread.where("_salt >= 0")
    if hot.isEmpty():
        return paired
    blocks = F.ceil(F.col("n") / most).cast("int")
    dealt = members.withColumn("_salt", salt).join(hot, ["key", "_salt"]).select("key", "_id", blocks.alias("_blocks"), F.pmod(F.xxhash64("_id", F.lit(7)), blocks.cast("long")).cast("int").alias("_block"))
    left = dealt.select("key", F.col("_id").alias("_a"), F.col("_block").alias("_i"), F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("_j"))
    right = dealt.select("key", F.col("_id").alias("_b"), F.col("_block").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_i"))
    across = left.join(right, ["key", "_i", "_j"]).where("_i < _j or _a < _b")
    return paired.unionByName(across.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")))


def similar_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", version_col: str | None = None, size: int = 5, tenths: int = 8, anchors: int | None = ANCHORS) -> DataFrame:
    """id_a < id_b: every pair of ids whose texts are equal or linked (see linked_texts)."""
    links, members = linked_texts(df, id_col, text_col, version_col, size, tenths, anchors)
    members = durable(members)
    a = members.select(F.col("_id").alias("_a"), F.col("key").alias("key_a"))
    b = members.select(F.col("_id").alias("_b"), F.col("key").alias("key_b"))
    across = links.join(a, "key_a").join(b, "key_b").select("_a", "_b")
    return across.union(copies(members)).select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))


def similar_groups(df: DataFrame, id_col: str = "id", text_col: str = "text", version_col: str | None = None, size: int = 5, tenths: int = 8, anchors: int | None = ANCHORS) -> DataFrame:
    """One row per id of a group of two or more: id, the group's least id, the text's links to other texts, its copies."""
    links, members = linked_texts(df, id_col, text_col, version_col, size, tenths, anchors)
    links, members = durable(links.select("key_a", "key_b")), durable(members)
    degrees = links.select(F.col("key_a").alias("key")).union(links.select("key_b")).groupBy("key").agg(F.count("*").alias("n_links"))
    texts = members.groupBy("key").agg(F.count("*").alias("n_copies"), F.min("_id").alias("_least"))
    classes = connected_components(links.select(F.col("key_a").alias("src"), F.col("key_b").alias("dst")))
    texts = texts.join(classes.withColumnRenamed("node", "key"), "key", "left").join(degrees, "key", "left")
    texts = texts.withColumn("component", F.coalesce("component", "key")).where("n_copies > 1 or n_links > 0")
    least = texts.groupBy("component").agg(F.min("_least").alias("group_id"))
    texts = texts.join(least, "component").select("key", "group_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return members.join(texts, "key").select(F.col("_id").alias("id"), "group_id", "n_links", "n_copies")
