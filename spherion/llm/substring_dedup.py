"""Removal of word passages that an earlier document has too: FM-index per shard.

A window is 13 consecutive words.  Equal windows have the same minimiser, the least hash of their five-word
sequences, so windows are dealt by it and meet in one shard.

1. Each task lists the minimisers of its documents; a shuffle finds those that two documents hold.
2. Runs of windows with such a minimiser are candidates.  A run whose words several documents of a task share goes to its
   shard only for the smallest doc_id; for the others it is settled there and then.  So a passage that a third of all
   documents hold reaches its shard once a task.
3. A shard builds an FM-index over the words of its runs and streams their windows through backward search over the
   wavelet matrix; each interval of 13 matching words yields the smallest doc_id that holds the window.
4. Documents drop the words that windows with a smaller doc_id cover.

Hashes only propose; the FM-index over the words themselves decides.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherion.llm.fmindex import FmIndex
from spherion.llm.pairs import expand
from spherion.llm.shared import input_bytes, partition_keys, partitions_for
from spherion.llm.textkernel import BASE, blocks, mixed, ngram_hashes, sliding_min, texts_of, word_hashes, word_spans

WINDOW, GRAM = 13, 5
#: Bytes of text a task looks at together, and of input per shard.
BLOCK, SHARD = 4 << 20, 8 << 20
#: How hard what is shuffled is compressed.
LEVEL = 9


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple:
    """(starts, ends, first, position, text, minimiser): the words, and each window's first word, text and minimiser."""
    starts, ends, first = word_spans(raw, offsets)
    least = sliding_min(ngram_hashes(word_hashes(raw, starts, ends), GRAM), WINDOW - GRAM + 1)
    count = np.maximum(np.diff(first) - (WINDOW - 1), 0)
    text = np.repeat(np.arange(len(count)), count)
    position = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[text]
    return starts, ends, first, position, text, least[position] if len(position) else np.zeros(0, np.uint64)


def _runs(position: np.ndarray, text: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices at which a run of windows of one text with one minimiser begins."""
    new = np.ones(len(position), bool)
    new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1]) | (position[1:] != position[:-1] + 1)
    return np.flatnonzero(new)


def _usable(batch: pa.RecordBatch) -> np.ndarray:
    return ~batch.column(0).is_null().to_numpy(zero_copy_only=False)


def _bucket(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[hashes % np.uint64(len(keys))]


def _minimiser_batches(keys: np.ndarray):
    """Rows (bucket, pairs): minimisers and row keys; a minimiser of several rows of a block goes once, with two of them."""

    def run(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(2))
            usable, row = _usable(batch), batch.column(1).to_numpy().view(np.uint32)
            for a, b in blocks(offsets, BLOCK):
                *_, position, text, least = windows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = _runs(position, text, least)
                text, least = text[at], least[at]
                keep = usable[a + text]
                text, least = text[keep], least[keep]
                order = np.lexsort((text, least))
                text, least = text[order], least[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
                text, least = text[new], least[new]
                group = np.cumsum(np.r_[True, least[1:] != least[:-1]][: len(least)]) - 1
                size = np.bincount(group, minlength=0)
                key = row[a + text]
                shared = size[group] > 1 if len(group) else np.zeros(0, bool)
                yield _known_rows(key[shared], least[shared])
                place = np.arange(len(group)) - (np.cumsum(size) - size)[group] if len(group) else group
                key, least = key[place < 2], least[place < 2]
                bucket = _bucket(least, keys)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, np.int64)
                pairs = [least[x].tobytes() + key[x].tobytes() for x in np.split(order, cut[1:])] if len(order) else []
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cut]), pa.array(np.ones(len(cut), np.int32)), pa.array(pairs, pa.binary())], ["bucket", "kind", "pairs"])

    def _known_rows(key, least):
        """Minimisers that rows are known to share, cut into pieces and dealt at random."""
        cut = range(0, len(key), 4096)
        pairs = [least[c : c + 4096].tobytes() + key[c : c + 4096].tobytes() for c in cut]
        bucket = _bucket(least[:: 4096], keys)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(pairs), np.int32)), pa.array(pairs, pa.binary())], ["bucket", "kind", "pairs"])

    return run


def _unpack(pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(pairs) // 12
    return np.frombuffer(pairs, np.uint64, n), np.frombuffer(pairs, np.uint32, n, 8 * n)


def _shared_batches(batches):
    """Pairs (key, minimiser) of minimisers that several rows hold."""
    held = []

    def rows(key, least):
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int32)), pa.array(least.view(np.int64))], ["key", "least"])

    for batch in batches:
        for kind, pairs in zip(batch.column(0).to_pylist(), batch.column(1)):
            least, key = _unpack(pairs.as_py())
            if kind:
                held.append((least, key))
            else:
                yield rows(key, least)
    if held:
        least, key = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(least, kind="stable")
        least, key = least[order], key[order]
        same = least[1:] == least[:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        yield rows(key[twice], least[twice])


#: What shards find, and what step 2 writes: texts without candidates are done; others packed by bucket with what is settled; runs for the shards.
FOUND, DONE, TEXT, RUNS = 0, 1, 2, 3
_STEP2_NAMES = ["kind", "bucket", "doc_id", "th", "n_words", "sha", "data"]
_STEP2 = "kind int, bucket int, doc_id long, th long, n_words long, sha string, data binary"


def _digest(words: bytes) -> str:
    return hashlib.sha256(words).hexdigest()


def _candidate_batches(keys: np.ndarray):
    def run(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(2))
            for a, b in blocks(offsets, BLOCK):
                yield _step2(batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def _step2(batch, raw, offsets):
        starts, ends, first, position, text, least = windows(raw, offsets)
        doc_ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        home = _bucket(batch.column(1).to_numpy().view(np.uint64), keys).tolist()
        # The words, one space after each.
        size = ends - starts
        at = np.cumsum(size + 1) - (size + 1)
        flat = np.full(int((size + 1).sum()), 0x20, np.uint8)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)
        flat[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = raw[inside]
        flat, to = flat.tobytes(), at + size
        # Windows whose minimiser is on the list of their row.
        lists = batch.column(3)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        salt = mixed(np.arange(len(n), dtype=np.uint64) * np.uint64(BASE))
        wanted = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.repeat(salt, n))
        asked = least ^ salt[text]
        found = np.zeros(len(asked), bool)
        if len(wanted):
            spot = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
            found = (wanted[spot] == asked) & _usable(batch)[text]
        position, text, least = position[found], text[found], least[found]
        run = _runs(position, text, least)
        stop = np.r_[run[1:], len(position)][: len(run)]
        words, owner, held, settled = {}, defaultdict(list), text[run].tolist(), defaultdict(list)
        begin, finish, bucket = position[run].tolist(), (position[stop - 1] + WINDOW).tolist() if len(run) else [], _bucket(least[run], keys).tolist()
        for k, (t, s, e) in enumerate(zip(held, begin, finish)):
            content = flat[at[s] : to[e - 1]]
            owner[content].append(k)
            words[content] = min(words.get(content, doc_ids[t]), doc_ids[t])
        sent = defaultdict(lambda: ([], [], [], [], []))
        for content, ks in owner.items():
            smallest, number = words[content], None
            for k in ks:
                t = held[k]
                if doc_ids[t] > smallest:
                    settled[t].append((begin[k] - first[t], finish[k] - begin[k] - WINDOW + 1))
                    continue
                contents, which, docs, rows, place = sent[bucket[k]]
                if number is None:
                    number = len(contents)
                    contents.append(content)
                which.append(number)
                docs.append(doc_ids[t])
                rows.append(ths[t])
                place.append(int(begin[k] - first[t]))
        out = []
        live, texts = set(held), defaultdict(list)
        n_words = np.diff(first).tolist()
        for t in range(len(doc_ids)):
            own = flat[at[first[t]] : to[first[t + 1] - 1]] if n_words[t] else b""
            if t in live:
                ranges: list[list[int]] = []
                for at_word, number in sorted(settled[t]):
                    if ranges and sum(ranges[-1]) == at_word:
                        ranges[-1][1] += number
                    else:
                        ranges.append([at_word, number])
                texts[home[t]].append((doc_ids[t], ths[t], n_words[t], np.array(ranges, np.int32).reshape(-1, 2).T, own))
            else:
                out.append((DONE, home[t], doc_ids[t], ths[t], n_words[t], _digest(own), None))
        for key, rows in texts.items():  # together they compress well
            out.append((TEXT, key, None, None, None, None, _packed_texts(rows)))
        for key, (contents, *columns) in sent.items():
            body = b"\n".join(contents)
            data = np.array([len(columns[0]), len(body)], np.int64).tobytes() + b"".join(np.array(c, np.int64).tobytes() for c in columns) + body
            out.append((RUNS, key, None, None, None, None, _squeezed(data)))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], _STEP2_NAMES)

    return run


def _shard_batches(keys: np.ndarray):
    """Passes texts on; adds rows of kind FOUND with the windows that begin in a smaller doc_id too, packed for a bucket of texts."""

    def run(batches):
        held = []
        for batch in batches:
            runs = batch.column(0).to_numpy() == RUNS
            held += batch.column(6).filter(pa.array(runs)).to_pylist()
            yield batch.filter(pa.array(~runs))
        found = _shard_windows(held)
        if found is not None and len(found[0]):
            docs, rows, where = found
            bucket = _bucket(rows.view(np.uint64), keys)
            order = np.lexsort((where, docs, rows, bucket))
            docs, rows, where, bucket = docs[order], rows[order], where[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
            data = [_packed(docs[x], rows[x], where[x]) for x in np.split(np.arange(len(rows)), cut[1:])]
            n = len(cut)
            none = [pa.nulls(n, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, FOUND, np.int32)), pa.array(bucket[cut]), *none, pa.nulls(n, pa.string()), pa.array(data, pa.binary())], _STEP2_NAMES)

    return run


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def _restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _packed_texts(rows: list[tuple]) -> bytes:
    """Texts (doc, row, words, settled ranges, bytes) as columns: their number, five int64 a text, the ranges, the bytes."""
    docs, keys, words, ranges, texts = zip(*rows)
    head = np.array([docs, keys, words, [r.shape[1] for r in ranges], [len(t) for t in texts]], np.int64)
    return _squeezed(np.int64(len(rows)).tobytes() + head.tobytes() + np.concatenate(ranges, axis=1).astype(np.int32).tobytes() + b"".join(texts))


def _unpacked_texts(data: bytes):
    """(doc, row, words, settled ranges, bytes) of what ``_packed_texts`` made."""
    body = _restored(data)
    n = int.from_bytes(body[:8], "little")
    docs, keys, words, count, size = np.frombuffer(body, np.int64, 5 * n, 8).reshape(5, n)
    ranges = np.frombuffer(body, np.int32, 2 * int(count.sum()), 8 + 40 * n).reshape(2, -1)
    stop = len(body) - int(size.sum()) + np.cumsum(size)
    texts = (body[e - s : e] for s, e in zip(size.tolist(), stop.tolist()))
    return zip(docs.tolist(), keys.tolist(), words.tolist(), np.split(ranges, np.cumsum(count)[:-1], axis=1), texts)


def _packed(docs: np.ndarray, rows: np.ndarray, where: np.ndarray) -> bytes:
    """Windows (sorted by rows, docs, where) as ranges [first, number), grouped by (docs, rows)."""
    apart = (np.diff(docs) != 0) | (np.diff(rows) != 0)
    group = np.flatnonzero(np.r_[True, apart])
    first = np.flatnonzero(np.r_[True, apart | (np.diff(where) > 1)])
    last = np.r_[first[1:], len(where)] - 1
    ranges = np.stack([where[first], where[last] - where[first] + 1]).astype(np.int32)
    count = np.diff(np.r_[np.searchsorted(first, group), len(first)])
    body = np.int64(len(group)).tobytes() + docs[group].tobytes() + rows[group].tobytes() + count.tobytes() + ranges.tobytes()
    return _squeezed(body)


def _unpacked(data: bytes):
    """(doc, row, ranges) of what ``_packed`` made."""
    body = _restored(data)
    n = int.from_bytes(body[:8], "little")
    docs, rows, count = np.frombuffer(body, np.int64, 3 * n, 8).reshape(3, n)
    ranges = np.frombuffer(body, np.int32, -1, 8 + 24 * n).reshape(2, -1)
    return zip(docs.tolist(), rows.tolist(), np.split(ranges, np.cumsum(count)[:-1], axis=1))


def _shard_windows(held: list[bytes]):
    """(docs, rows, windows) of removed windows, or None for an empty shard."""
    number: dict[bytes, int] = {}
    columns = []
    while held:
        data = _restored(held.pop())
        n, _ = np.frombuffer(data, np.int64, 2)
        which, docs, rows, place = np.frombuffer(data, np.int64, 4 * n, 16).reshape(4, n)
        own = np.array([number.setdefault(c, len(number)) for c in data[16 + 32 * n :].split(b"\n")], np.int64)
        columns.append((own[which], docs, rows, place))
    if not columns:
        return None
    which, docs, rows, place = (np.concatenate(c) for c in zip(*columns))
    smallest = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, docs)
    # The text of the shard: runs, each followed by the separator.
    vocabulary: dict[bytes, int] = {}
    size = np.zeros(len(number), np.int64)
    symbols = array("i")
    for k, content in enumerate(number):
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in content.split(b" ")]
        size[k] = len(own)
        own.append(0)
        symbols.extend(own)
    number.clear()
    text = np.frombuffer(symbols, np.int32)
    begin = np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(len(size)), size + 1)
    index = FmIndex(text, len(vocabulary) + 1, WINDOW)
    # Every window of every run, and the smallest document that holds it.
    count = size - (WINDOW - 1)
    base = np.cumsum(count) - count
    window = np.repeat(begin - base, count) + np.arange(int(count.sum()))
    least = smallest[np.repeat(np.arange(len(size)), count)]
    lo, hi = index.search(text, window, WINDOW, least=2)
    several = np.flatnonzero(hi > lo)
    if len(several):
        spans, back = np.unique(lo[several], return_inverse=True)
        stop = np.zeros(len(spans), np.int64)
        stop[back] = hi[several]
        held = np.append(smallest[owner[index.suffixes]], np.iinfo(np.int64).max)
        lowest = np.minimum.reduceat(held, np.stack([spans, stop], 1).ravel())[::2]
        least[several] = lowest[back]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for i, j in expand(base[which], (base + count)[which], 1 << 20):
        earlier = least[j] < docs[i]
        i, j = i[earlier], j[earlier]
        out.append((docs[i], rows[i], (place[i] + j - base[which[i]]).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _kept_batches(batches):
    """Found windows (kind FOUND) come first in a partition, then the texts: what is done, and what they are for."""
    found = defaultdict(list)
    for batch in batches:
        out = []
        for kind, _, doc, _, n, sha, data in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == DONE:
                out.append((doc, n, 0, sha, None))
                continue
            if kind == FOUND:
                for d, r, where in _unpacked(data):
                    found[d, r].append(where)
                continue
            for doc, th, n, settled, own in _unpacked_texts(data):
                first, number = np.concatenate([settled, *found.get((doc, th), ())], axis=1)
                gone = np.zeros(n + 1, np.int32)
                np.add.at(gone, first, 1)
                np.add.at(gone, first + number + (WINDOW - 1), -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = b" ".join([w for w, g in zip(own.split(b" "), gone.tolist()) if not g])
                out.append((doc, n, int(gone.sum()), _digest(kept), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): a row per row of ``docs``.

    Words are cut at ASCII white space.  A null, empty or short text loses nothing.  ``kept`` is the kept text, null where
    nothing was removed.  Rows with a null doc_id neither lose words nor make others lose them; rows with equal doc_id
    don't affect each other; an empty table gives an empty table; other columns are not read.
    """
    shards = partitions_for(spark, input_bytes(docs, "text"), SHARD)
    keys = partition_keys(spark, shards)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    given = given.select("doc_id", F.xxhash64("doc_id", "text").alias("th"), "text")
    key = F.shiftright("th", 32).cast("int")
    listed = given.select("doc_id", key.alias("key"), "text").mapInArrow(_minimiser_batches(keys), "bucket int, kind int, pairs binary")
    shared = listed.repartition(shards, "bucket").select("kind", "pairs").mapInArrow(_shared_batches, "key int, least long")
    lists = shared.groupBy("key").agg(F.collect_set("least").alias("lists")).withColumnRenamed("key", "k")
    joined = given.join(lists, key == lists["k"], "left").select("doc_id", "th", "text", "lists")
    step2 = joined.mapInArrow(_candidate_batches(keys), _STEP2).repartition(shards, "bucket")
    step3 = step2.mapInArrow(_shard_batches(keys), _STEP2).repartition(shards, "bucket").sortWithinPartitions("kind")
    return step3.mapInArrow(_kept_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
