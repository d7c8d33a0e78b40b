"""BPE encoding with content-defined chunks: what documents share is encoded once.

A rolling hash over the last bytes cuts a text into chunks at white space, so
equal passages fall into equal chunks wherever they stand. The chunks that
would save most are counted over all documents, encoded once and handed to
every task as a dictionary of bounded size; tasks keep what else they meet in
a bounded cache. Joins between chunks are then repaired: the words around a
join are encoded again in a growing window until its ends agree with both
chunks. Where the tokenizer itself drops white space, no token crosses a join
and there is nothing to repair; chunks are then put together from words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import SpanHasher, text_slices, with_columns

WINDOW = 24
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = re.compile("[^\t\n\x0b\x0c\r ]+")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")  # one code point per letter in any normal form


def cuts(data: np.ndarray, bounds: np.ndarray, mask: int) -> np.ndarray:
    """Chunk starts of all rows: row starts, and white space after a word where the rolling hash says so.

    The hash covers the WINDOW bytes before the cut, all of the same row, so a
    cut depends on the content around it and on nothing else.
    """
    if not len(data):
        return np.empty(0, np.int64)
    space = SPACE[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    begins = bounds[np.searchsorted(bounds, at, side="right") - 1]
    at = at[at - begins >= WINDOW]
    hashes = SpanHasher(data)(at - WINDOW, at)
    firsts = np.unique(bounds[:-1][np.diff(bounds) > 0])
    return np.union1d(firsts, at[(hashes & np.uint64(mask)) == 0])


def last_words(text: str, width: int) -> int:
    """Where the last ``width`` words begin, with the white space before them; 0 if there are no more."""
    span = 256 * width
    while True:
        base = max(0, len(text) - span)
        ends = [m.end() for m in WORD.finditer(text, base)]
        if not base or len(ends) > width + 1:
            return ends[-width - 1] if len(ends) > width else 0
        span *= 4


def first_words(text: str, width: int) -> int:
    """Where the first ``width`` words end; the text's length if there are no more."""
    end = 0
    for n, m in enumerate(WORD.finditer(text)):
        if n == width:
            return end
        end = m.end()
    return len(text)


class Recent:
    """Two generations of a dict: a full young one becomes the old one, so at most 2 x ``most`` bytes are held, entry by entry with OVERHEAD."""

    OVERHEAD = 150

    def __init__(self, most: int) -> None:
        self.most, self.held, self.young, self.old = most, 0, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if self.held >= self.most:
            self.held, self.old, self.young = 0, self.young, {}
        self.held += len(key) + len(value) + self.OVERHEAD
        self.young[key] = value


def packed(ids: Sequence[int]) -> bytes:
    """Ids as the bytes of 32-bit numbers: small to keep, and joined without a loop."""
    return np.asarray(ids, np.int32).tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, np.int32).tolist()


class Encoder:
    """Tokenizer of one task with its caches of ``words`` and ``chunks`` bytes. Built inside the task from the vocabulary file."""

    def __init__(self, path: str, shared: dict[bytes, bytes] | None = None, words: int = 12 << 20, chunks: int = 6 << 20) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.shared, self.words, self.chunks = shared or {}, Recent(words), Recent(chunks)

    @cached_property
    def spec(self) -> dict:
        return json.loads(self.tokenizer.to_str())

    @cached_property
    def drops_space(self) -> bool:
        """Whether the pre-tokenizer keeps only matches of a pattern that can't match white space."""
        pre = self.spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        if first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
            return True
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
            pattern = first["pattern"].get("Regex", "")
            bare = re.sub(r"\[\^\\s[^\]]*\]", "", pattern)  # a class that excludes white space
            return not re.search(r"\\s|\\S|\\W|\\D|\\P|\[\^|\.| ", bare)
        return False

    @cached_property
    def ends_word(self) -> np.ndarray | None:
        """Per id, whether its token closes a pre-token; None if the vocabulary doesn't mark that."""
        suffix = self.spec["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        return ends

    @cached_property
    def pieces(self):
        import regex

        return regex.compile(self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def plain(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def new_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word. Plain words go in lines of many: tokens that close a pre-token tell where each word ends.

        A line whose count of such tokens isn't the expected one is encoded word by word.
        """
        first = (self.spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if self.ends_word is None or first.get("type") != "Split":
            return list(map(packed, self.plain(words)))
        out: dict[str, bytes] = {}
        simple = [w for w in words if PLAIN.fullmatch(w) and "<" not in w]
        lines = [simple[i : i + 256] for i in range(0, len(simple), 256)]
        for line, ids in zip(lines, self.plain(["\n".join(line) for line in lines])):
            counts = np.fromiter((len(self.pieces.findall(w.lower())) for w in line), np.int64, len(line))
            ends = np.flatnonzero(self.ends_word[np.array(ids, np.int64)]) + 1 if ids else np.empty(0, np.int64)
            if counts.min() > 0 and len(ends) == counts.sum() and (not len(ends) or ends[-1] == len(ids)):
                stops = ends[np.cumsum(counts) - 1].tolist()
                whole = packed(ids)
                for w, a, b in zip(line, [0, *stops], stops):
                    out[w] = whole[4 * a : 4 * b]
        rest = [w for w in words if w not in out]
        out.update(zip(rest, map(packed, self.plain(rest))))
        return [out[w] for w in words]

    def encode_chunks(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of every chunk as a text of its own."""
        found: dict[bytes, bytes] = {}
        missing = []
        for c in dict.fromkeys(chunks):
            ids = self.shared.get(c) or self.chunks.get(c)
            if ids is None:
                missing.append(c)
            else:
                found[c] = ids
        if self.drops_space:
            split = [WORD.findall(c.decode()) for c in missing]
            local: dict[str, bytes] = {}
            fresh = []
            for w in dict.fromkeys(chain.from_iterable(split)):
                ids = self.words.get(w)
                if ids is None:
                    fresh.append(w)
                else:
                    local[w] = ids
            for w, ids in zip(fresh, self.new_words(fresh)):
                local[w] = ids
                self.words.put(w, ids)
            made = [b"".join(map(local.__getitem__, words)) for words in split]
        else:
            made = list(map(packed, self.plain([c.decode() for c in missing])))
        for c, ids in zip(missing, made):
            found[c] = ids
            if len(c) <= 1 << 14:
                self.chunks.put(c, ids)
        return found

    def join(self, texts: list[str], parts: list[list[int]]) -> list[int]:
        """Ids of the joined chunks, from the ids of each."""
        if self.drops_space or len(texts) < 2:
            return list(chain.from_iterable(parts))
        ids, text = list(parts[0]), texts[0]
        for right, tail in zip(texts[1:], parts[1:]):
            width, before = 1, None
            while True:
                a, b = last_words(text, width), first_words(right, width)
                head, rest, middle = self.plain([text[a:], right[:b], text[a:] + right[:b]])
                # agreement: the chunks hold what either window holds alone, the joined window begins and ends like them, and a wider one gives the same ids
                left_ok = a == 0 or (ids[len(ids) - len(head) :] == head and middle[:1] == head[:1])
                right_ok = b == len(right) or (tail[: len(rest)] == rest and middle[-1:] == rest[-1:])
                joined = (ids[: len(ids) - len(head)] if a else []) + middle + (tail[len(rest) :] if b < len(right) else [])
                if left_ok and right_ok and (joined == before or (a == 0 and b == len(right))):
                    break
                before = joined if left_ok and right_ok else None
                width *= 2
            ids, text = joined, text + right
        return ids

    def encode(self, texts: list[bytes], starts: list[list[int]]) -> list[bytes]:
        """Packed ids of every text; ``starts`` are its chunk starts."""
        chunked = [[t[a:b] for a, b in zip(s, [*s[1:], len(t)])] for t, s in zip(texts, starts)]
        known = self.encode_chunks(list(chain.from_iterable(chunked)))
        if self.drops_space:
            return [b"".join(map(known.__getitem__, cs)) for cs in chunked]
        return [packed(self.join([c.decode() for c in cs], [unpacked(known[c]) for c in cs])) if cs else b"" for cs in chunked]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        if self.spec.get("decoder") is None:  # the library then joins the tokens by a space
            return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values)), " ")
        return pa.array(self.tokenizer.decode_batch(ids.to_pylist(), skip_special_tokens=False), pa.string())

    @cached_property
    def tokens(self) -> pa.Array:
        return pa.array([self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())], pa.string())


def shared_chunks(docs: DataFrame, path: str, text: str = "text", mask: int = 63, most: int = 16_384, longest: int = 4096) -> dict[bytes, bytes]:
    """Packed ids of up to ``most`` chunks of at most ``longest`` bytes whose reuse saves most, over all documents.

    Chunk hashes and counts are combined on the map side; counts of savings, in
    steps of a twelfth, tell how many steps from the top fit; each of those
    texts is then picked once and encoded once.
    The result is bounded by ``most`` x ``longest`` bytes of text, whatever the
    corpus; it decides speed only, as any other chunk is encoded where it stands.
    """

    def hashed(batches):
        for batch in batches:
            for _, data, bounds in text_slices(batch, text):
                at = cuts(data, bounds, mask)
                ends = np.append(at[1:], len(data))
                keys, first, n = np.unique(SpanHasher(data)(at, ends), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array((ends - at)[first]), pa.array(n)], names=["key", "bytes", "n"])

    counts = docs.select(text).mapInArrow(hashed, "key long, bytes long, n long").where(F.col("bytes") <= longest)
    repeated = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes")).where("n >= 2")
    savings = written(repeated.select("key", F.floor(8 * F.log2(F.expr("(n - 1) * bytes + 1"))).alias("saves")), "chunk-savings")
    floor, total = None, 0
    for r in savings.groupBy("saves").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("saves")).collect():  # some hundred steps
        total += r["n"]
        if total > most:
            break
        floor = r["saves"]
    if floor is None:
        return {}
    keys = savings.where(F.col("saves") >= floor).select("key").toPandas()["key"].to_numpy(np.int64)  # at most ``most`` rows
    if not len(keys):
        return {}
    wanted = np.sort(keys.view(np.uint64))

    def picked(batches):
        seen = np.zeros(len(wanted), bool)
        for batch in batches:
            for _, data, bounds in text_slices(batch, text):
                at = cuts(data, bounds, mask)
                ends = np.append(at[1:], len(data))
                h = SpanHasher(data)(at, ends)
                spot = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                hit = np.flatnonzero((wanted[spot] == h) & ~seen[spot] & (ends - at <= longest))
                _, one = np.unique(spot[hit], return_index=True)
                hit = hit[one]
                seen[spot[hit]] = True
                if len(hit):
                    raw = data.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array([raw[a:b] for a, b in zip(at[hit].tolist(), ends[hit].tolist())], pa.binary())], names=["key", "chunk"])

    def encoded(batches):
        encoder = Encoder(path)
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            ids = encoder.encode_chunks(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array([ids[c] for c in chunks], pa.binary())], names=["chunk", "ids"])

    once = docs.select(text).mapInArrow(picked, "key long, chunk binary").dropDuplicates(["key"]).select("chunk")
    found = once.mapInArrow(encoded, "chunk binary, ids binary").toArrow()  # at most ``most`` chunks of ``longest`` bytes
    return dict(zip(found.column("chunk").to_pylist(), found.column("ids").to_pylist()))


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", mask: int = 63, most_shared: int = 16_384, word_cache: int = 12 << 20) -> DataFrame:
    """Every row with ``ids`` (array<int>) and ``decoded`` (the ids decoded again); columns of these names are replaced.

    Ids equal the library's encode(text, add_special_tokens=False) without
    truncation or padding, ``decoded`` its decode(ids, skip_special_tokens=False).
    ``path`` is the vocabulary file, at the same place on every executor. A null
    or empty text has no ids. No row moves: chunk counts are the only shuffle.
    ``word_cache`` are the bytes of words a task may keep in each of two
    generations; a larger one saves time where the vocabulary is large.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, text, mask, most_shared))

    def of_task():
        encoder = Encoder(path, shared.value, word_cache)

        def make(_texts, data, bounds):
            at = cuts(data, bounds, mask)
            raw, ends = data.tobytes(), bounds[1:].tolist()
            spans = np.split(at, np.searchsorted(at, bounds[1:-1]))
            starts = [(s - b).tolist() for s, b in zip(spans, bounds[:-1].tolist())]
            ids = encoder.encode([raw[a:b] for a, b in zip(bounds[:-1].tolist(), ends)], starts)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) // 4 for i in ids], out=offsets[1:])
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            return rows, encoder.decode(rows)

        return make

    return with_columns(docs, text, "ids array<int>, decoded string", of_task, per_task=True)


def digests(encoded: DataFrame) -> DataFrame:
    """``encoded`` with n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 in place of the ids and texts."""
    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }).drop("ids", "decoded")
