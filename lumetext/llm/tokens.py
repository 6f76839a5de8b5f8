"""Problem 8: a corpus as the token ids of a public tokenizer, and the token counts that problems 9 and 10 measure sizes in.

Method: recursive DuckDB queries per partition. The distinct words of a batch become rows of (word, position, token); each round of
the recursion joins them to the merge table and contracts, in every word, the pair of least rank from the left, until no pair of
any word is in the table; an ordered aggregation gives the words' ids back.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from .common import scratch

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"

#: The word pattern of the byte-level tokenizers (a fixed value of the vocabulary).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words of one DuckDB call, and words whose ids a worker keeps; both bound its memory.
CALL_WORDS, KEPT_WORDS = 15_000, 300_000

#: Words longer than this are not kept.
KEPT_CHARS = 40

#: Bytes from which a word is contracted in windows, bytes of such words in one DuckDB call, and rounds of one recursion of theirs:
#: a recursion keeps the rows of all its rounds, so it is begun anew from its last ones.
LONG_BYTES, CALL_BYTES, ROUNDS = 192, 400_000, 12

# In each round all occurrences of a word's least rank are contracted, every other one of a run of equal tokens: the same as the
# leftmost one again and again, as a merge's product only occurs in merges of higher rank.
_CONTRACT = """
WITH RECURSIVE step(it, wid, pos, tok) AS (
  SELECT 0::INT, wid, pos, tok FROM words
  UNION ALL
  SELECT it + 1, wid, pos, CASE WHEN take THEN merged ELSE tok END
  FROM (
    SELECT *, coalesce(lag(take) OVER w, false) AS gone
    FROM (
      SELECT *, rank = best AND (nth - coalesce(max(CASE WHEN rank IS DISTINCT FROM best THEN nth END) OVER (w ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS take
      FROM (
        SELECT s.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY s.wid) AS best
        FROM (SELECT *, lead(tok) OVER w AS following, row_number() OVER w AS nth FROM step WINDOW w AS (PARTITION BY wid ORDER BY pos)) s
        LEFT JOIN merges m ON m.first = s.tok AND m.second = s.following
      )
      WHERE best IS NOT NULL
      WINDOW w AS (PARTITION BY wid ORDER BY pos)
    )
    WINDOW w AS (PARTITION BY wid ORDER BY pos)
  )
  WHERE NOT gone
)
SELECT wid, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(it) OVER (PARTITION BY wid) AS last FROM step)
WHERE it = last GROUP BY wid ORDER BY wid
"""


# A long word is contracted at many places in one round: a pair goes if no pair around it has a lower rank, as far as any token reaches.
# For a pair to be broken before its turn, one of its tokens must first merge with a token beside it; that token is there already or
# comes of a pair of lower rank, and both together are a token of the vocabulary and a part of the word, so that pair lies within the
# bytes of the longest token that the word holds anywhere.
# Of a run of equal pairs every other one from the run's beginning goes, if nothing around any of them is of lower rank.
_CONTRACT_LONG = """
WITH RECURSIVE step(it, wid, pos, tok) AS (
  SELECT 0::INT, wid, pos, tok FROM words
  UNION ALL
  SELECT it + 1, wid, pos, CASE WHEN take THEN merged ELSE tok END
  FROM (
    SELECT *, coalesce(lag(take) OVER w, false) AS gone
    FROM (
      SELECT *, least_here AND coalesce(max(CASE WHEN NOT least_here THEN nth END) OVER (w ROWS UNBOUNDED PRECEDING), 0) < begun AND (nth - begun) % 2 = 0 AS take
      FROM (
        SELECT *, rank IS NOT NULL AND rank = best AS least_here, max(CASE WHEN rank IS DISTINCT FROM before THEN nth END) OVER (w ROWS UNBOUNDED PRECEDING) AS begun
        FROM (
          SELECT *, lag(rank) OVER w AS before, bool_or(rank IS NOT NULL) OVER (PARTITION BY wid) AS live, min(rank) OVER (w RANGE BETWEEN {reach} PRECEDING AND {twice} FOLLOWING) AS best
          FROM (
            SELECT s.*, m.rank, m.merged
            FROM (SELECT *, lead(tok) OVER w AS following, row_number() OVER w AS nth FROM step WINDOW w AS (PARTITION BY wid ORDER BY pos)) s
            LEFT JOIN merges m ON m.first = s.tok AND m.second = s.following
          )
          WINDOW w AS (PARTITION BY wid ORDER BY pos)
        )
        WHERE live AND it < {rounds}
        WINDOW w AS (PARTITION BY wid ORDER BY pos)
      )
      WINDOW w AS (PARTITION BY wid ORDER BY pos)
    )
    WINDOW w AS (PARTITION BY wid ORDER BY pos)
  )
  WHERE NOT gone
)
SELECT wid, pos, tok, last = {rounds} AS open FROM (SELECT *, max(it) OVER (PARTITION BY wid) AS last FROM step) WHERE it = last ORDER BY wid, pos
"""


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the others for the
    letters from U+0100 on, in their order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def words_of(text: str, pattern=regex.compile(WORD)) -> list[str]:
    return pattern.findall(text)


class WordEncoder:
    """Ids of words by recursive contraction in DuckDB; frequent words are remembered."""

    def __init__(self, path: str) -> None:
        import duckdb

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.bytes = np.array([vocab[c] for c in byte_letters()], "int32")
        self.spill = scratch("tokens-")  # gone with the worker
        self.vocab, self.letters, self.parts = vocab, byte_letters(), None
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": self.spill.name})
        self.con.register("given", pa.table({"first": pa.array([vocab[a] for a, _ in merges], pa.int32()), "second": pa.array([vocab[b] for _, b in merges], pa.int32()), "merged": pa.array([vocab[a + b] for a, b in merges], pa.int32()), "rank": pa.array(range(len(merges)), pa.int32())}))
        self.con.sql("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self.known: dict[str, list[int]] = {}

    def _contract(self, words: list[str]) -> list[list[int]]:
        """The ids of words, short and long ones apart."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [i for i, b in enumerate(raw) if len(b) <= LONG_BYTES]
        out: list[list[int]] = [[]] * len(raw)
        if short:
            for i, ids in zip(short, self._contract_short([raw[i] for i in short]), strict=True):
                out[i] = ids
        part, held, reach = [], 0, 0
        for far, i in sorted((self._reach(b), i) for i, b in enumerate(raw) if len(b) > LONG_BYTES):
            if part and (held >= CALL_BYTES or far > reach + 4):
                self._contract_long(raw, part, reach, out)
                part, held = [], 0
            part.append(i)
            held += len(raw[i])
            reach = far
        if part:
            self._contract_long(raw, part, reach, out)
        return out

    def _reach(self, word: bytes) -> int:
        """Bytes of the longest token that a word holds anywhere."""
        if self.parts is None:
            import ahocorasick

            self.parts = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for token in self.vocab:
                self.parts.add_word(token)
            self.parts.make_automaton()
        text = "".join(map(self.letters.__getitem__, word))
        return max(n for _, n in self.parts.iter(text))

    def _contract_long(self, raw: list[bytes], which: list[int], reach: int, out: list[list[int]]) -> None:
        size = np.array([len(raw[i]) for i in which])
        wid = np.repeat(np.array(which, "int32"), size)
        pos = np.arange(len(wid)) - np.repeat(np.cumsum(size) - size, size)
        rows = pa.table({"wid": wid, "pos": pos.astype("int32"), "tok": self.bytes[np.frombuffer(b"".join(raw[i] for i in which), "uint8")]})
        query = _CONTRACT_LONG.format(reach=reach, twice=2 * reach, rounds=ROUNDS)
        while len(rows):
            self.con.register("words", rows)
            got = self.con.sql(query).to_arrow_table()
            self.con.unregister("words")
            open_ = got.column("open").combine_chunks()
            done = got.filter(pc.invert(open_))
            ids, toks = done.column("wid").to_numpy(), done.column("tok").to_numpy()
            ends = np.flatnonzero(np.diff(ids, append=-1)) + 1
            begin = 0
            for end in ends.tolist():
                out[int(ids[begin])] = toks[begin:end].tolist()
                begin = end
            rows = got.filter(open_).select(["wid", "pos", "tok"])

    def _contract_short(self, raw: list[bytes]) -> list[list[int]]:
        size = np.array([len(b) for b in raw])
        wid = np.repeat(np.arange(len(raw), dtype="int32"), size)
        pos = np.arange(len(wid)) - np.repeat(np.cumsum(size) - size, size)
        self.con.register("words", pa.table({"wid": wid, "pos": pos.astype("int32"), "tok": self.bytes[np.frombuffer(b"".join(raw), "uint8")]}))
        ids = self.con.sql(_CONTRACT).to_arrow_table().column("ids").to_pylist()
        self.con.unregister("words")
        return ids

    def learn(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of at least these words."""
        new = [w for w in words if w not in self.known]
        if new and len(self.known) + len(new) > KEPT_WORDS:
            self.known = {}
            new = list(words)
        for k in range(0, len(new), CALL_WORDS):
            part = new[k : k + CALL_WORDS]
            self.known.update(zip(part, self._contract(part), strict=True))
        return self.known

    def forget_long(self) -> None:
        for w in [w for w in self.known if len(w) > KEPT_CHARS]:
            del self.known[w]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary in a worker process, which Spark uses for task after task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def chunks_of(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts in runs of bounded length (a longer text alone)."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            at = 0
            for texts in chunks_of(batch.column(1).to_pylist()):
                words = [words_of(t) if t else [] for t in texts]
                known = encoder.learn(set(chain.from_iterable(words)))
                flat: list[int] = []
                ends = [0]
                for w in words:
                    flat.extend(chain.from_iterable(map(known.__getitem__, w)))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(flat, "int32", len(flat))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], names=["_k", "ids"])
                at += len(texts)
            encoder.forget_long()

    return run


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): each row's text as ids of a byte-level BPE vocabulary, without special tokens.

    An empty and a null text give an empty list; strings that look like special tokens are ordinary text. Every row comes out
    once, repeated rows as often as they come. Nothing is shuffled but a table too
    small to occupy all cores (see spread), and a row's ids hang on its own text alone.
    """
    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))).mapInArrow(_encode(f"{folder}/{vocabulary}"), f"_k {kind}, ids array<int>").withColumnRenamed("_k", key)


def token_texts(ids: DataFrame, key: str = "doc_id", column: str = "ids", vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the way back. An empty list gives an empty text; bytes that are no UTF-8 become U+FFFD."""
    kind = ids.schema[key].dataType.simpleString()
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        raw = {i: b"".join(byte[c] for c in w) for w, i in vocab.items() if all(c in byte for c in w)}
        for batch in batches:
            texts = [b"".join(raw[i] for i in row or []).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_k", "text"])

    return ids.select(F.col(key).alias("_k"), F.col(column).alias("_i")).mapInArrow(run, f"_k {kind}, text string").withColumnRenamed("_k", key)


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path)
        for batch in batches:
            sizes = [sum(map(len, count(t))) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def library_encoding(path: str):
    """The same vocabulary in the public library, which problems 9 and 10 count with."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})


_LIBRARY: dict[str, object] = {}


def token_counter(path: str) -> Callable[[str], list[list[int]]]:
    if path not in _LIBRARY:
        _LIBRARY[path] = library_encoding(path)
    encoding = _LIBRARY[path]
    return lambda text: [encoding.encode_ordinary(text)]


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(the kept columns, n_tokens): each row's number of tokens, 0 for a null or empty text."""
    fields = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    own = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text).alias("_t"))
    return spread(own).mapInArrow(_count(f"{folder}/{vocabulary}"), f"{fields}, n_tokens long").toDF(*keep, "n_tokens")
