"""Byte-level BPE, encoded and decoded by DuckDB queries inside each task.

Spark deals out the documents. A task cuts its texts into words by the tokenizer's pattern and sends the
words it hasn't met yet to an in-memory DuckDB: rows of (word, position, token) join the merge table, each
word's leftmost pair of least rank is contracted, and a recursive query repeats this until no word changes.
Decoding joins token rows with the vocabulary and aggregates in order of position.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words after which a worker sets those it remembers aside. Of these, the ones that come up again are kept when it next does so.
REMEMBERED = 200_000
#: Bytes of distinct new words, and tokens to decode, in one DuckDB query.
WORD_BYTES, TOKENS = 1 << 19, 1 << 20
#: Words of more bytes contract every occurrence of a pair at a time, where that can't change the outcome.
SHORT = 48
#: Rows (positions times steps) that one recursive query may produce for long words.
LONG_ROWS = 2_000_000

#: Short words. A row holds a token, the place and token of its right neighbour, and ``best``: rank, place and
#: neighbour's place of the pair that both make, in one number. Of the contracted pair the right row stays, at the left
#: one's place. A word without pairs is handed on once more, as done.
_SHORT_WALK = """
WITH RECURSIVE walk(word, pos, tok, nxt, ntok, best, done) AS (
  SELECT word, pos, tok, nxt, ntok, m.made * 65536 + pos * 256 + nxt, false FROM fresh LEFT JOIN merges m ON m.ab = fresh.tok * 4294967296 + fresh.ntok
  UNION ALL
  SELECT s.word, s.pos, s.tok, s.nxt, s.ntok, CASE WHEN s.ab IS NULL THEN s.best ELSE m.made * 65536 + s.pos * 256 + s.nxt END, s.done
  FROM (
    SELECT word, CASE WHEN pos = q THEN p ELSE pos END AS pos, CASE WHEN pos = q THEN made ELSE tok END AS tok, nxt,
      CASE WHEN nxt = p THEN made ELSE ntok END AS ntok, best, made IS NULL AS done,
      CASE WHEN pos = q AND ntok >= 0 THEN made * 4294967296 + ntok WHEN nxt = p THEN tok * 4294967296 + made WHEN pos = q THEN -1 END AS ab
    FROM (SELECT word, best >> 16 AS made, (best >> 8) & 255 AS p, best & 255 AS q FROM (SELECT word, min(best) AS best FROM walk WHERE NOT done GROUP BY word)) JOIN walk USING (word)
    WHERE p IS NULL OR pos <> p
  ) s LEFT JOIN merges m ON m.ab = s.ab
)
SELECT word, list(tok ORDER BY pos) AS toks, 0 AS step FROM walk WHERE done GROUP BY word ORDER BY word
"""
#: Long words: token-position rows with window functions, so many steps at a time.
_LONG_WALK = """
WITH RECURSIVE walk(word, step, pos, tok) AS (
  SELECT word, 0, pos, tok FROM fresh
  UNION ALL
  SELECT word, step + 1, pos, CASE WHEN taken THEN made ELSE tok END
  FROM (SELECT *, coalesce(lag(taken) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM ({taken}))
  WHERE NOT gone
),
final AS (SELECT word, max(step) AS step FROM walk GROUP BY word)
SELECT word, list(tok ORDER BY pos) AS toks, max(step) AS step FROM walk JOIN final USING (word, step) GROUP BY word ORDER BY word
"""
#: Every pair of neighbours with the token it makes; a word without any pair isn't walked further.
_PAIRS = """
SELECT p.*, m.made, m.made IS NOT NULL AND m.made = min(m.made) OVER (PARTITION BY p.word) AS least
FROM (SELECT *, lead(tok) OVER here AS nxt, lag(tok) OVER here AS before, lead(tok, 2) OVER here AS after FROM walk {limit} WINDOW here AS (PARTITION BY word ORDER BY pos)) p
LEFT JOIN merges m ON m.ab = p.tok::BIGINT * 4294967296 + p.nxt
QUALIFY min(m.made) OVER (PARTITION BY p.word) IS NOT NULL
"""
#: In a run of overlapping pairs, as in "aaaa", the first, third, ... are taken, up to the first whose new token
#: would at once make a pair of lower rank with a neighbour.
_EVERY = (
    "SELECT *, least AND nth % 2 = 1 AND pos <= coalesce(min(CASE WHEN risk THEN pos END) OVER (PARTITION BY word), pos) AS taken FROM ("
    "SELECT *, row_number() OVER (PARTITION BY word, least, run ORDER BY pos) AS nth FROM ("
    "SELECT q.*, count(*) FILTER (NOT least) OVER (PARTITION BY word ORDER BY pos) AS run, l.c IS NOT NULL OR r.c IS NOT NULL OR s.c IS NOT NULL AS risk FROM ("
    + _PAIRS
    + ") q LEFT JOIN risky_left l ON q.least AND q.made = l.c AND q.before = l.x LEFT JOIN risky_right r ON q.least AND q.made = r.c AND q.after = r.x LEFT JOIN risky_self s ON q.least AND q.made = s.c))"
)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Codec:
    """The merge table and the vocabulary in DuckDB, with the words met so far."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.words = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"ranks lack {len(missing)} single bytes")
        self.byte_tok = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        a, b, made = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), made.append(rank)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB"})
        self.db.execute("SET enable_progress_bar = false")
        pairs = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "made": pa.array(made, pa.int32())})
        self.db.execute("CREATE TABLE merges AS SELECT a::BIGINT * 4294967296 + b AS ab, made::BIGINT AS made FROM pairs")
        # Neighbours with which a new token makes a pair of lower rank than its own.
        self.db.execute("CREATE TABLE risky_left AS SELECT b AS c, a AS x FROM pairs WHERE made < b")
        self.db.execute("CREATE TABLE risky_right AS SELECT a AS c, b AS x FROM pairs WHERE made < a")
        self.db.execute("CREATE TABLE risky_self AS SELECT a AS c FROM pairs WHERE a = b AND made < a")
        # One character stands for a byte; for byte 0 it is U+0100.
        text = pa.array([t.decode("latin-1").replace("\0", "Ā") for t in self.ranks], pa.string())
        vocabulary = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "txt": text})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")

    def _walk(self, words: list[bytes], long: bool) -> list[bytes]:
        """Token ids of words, packed."""
        lengths = np.array([len(w) for w in words], np.int64)
        toks = [self.byte_tok[np.frombuffer(w, np.uint8)] for w in words]
        out: list[bytes] = [b""] * len(words)
        open_words = np.arange(len(words))
        while len(open_words):
            lengths = np.array([len(toks[i]) for i in open_words])
            total = int(lengths.sum())
            word = np.repeat(open_words, lengths)
            last = np.cumsum(lengths) - 1
            pos = np.arange(total) - np.repeat(last + 1 - lengths, lengths)
            tok = np.concatenate([toks[i] for i in open_words]).astype(np.int64)
            nxt, ntok = pos + 1, np.append(tok[1:], -1)
            ntok[last] = -1
            fresh = pa.table({"word": word, "pos": pos, "tok": tok, "nxt": nxt, "ntok": ntok})  # noqa: F841
            steps = max(1, LONG_ROWS // max(1, total)) if long else None
            query = _LONG_WALK.format(taken=_EVERY.format(limit=f"WHERE step < {steps}")) if long else _SHORT_WALK
            found = self.db.sql(query).to_arrow_table()
            flat = found["toks"].combine_chunks()
            offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            rows, step = found["word"].to_numpy(), found["step"].to_numpy()
            going = []
            for k, i in enumerate(rows):
                toks[i] = values[offsets[k] : offsets[k + 1]]
                if steps and step[k] >= steps:
                    going.append(i)
            open_words = np.array(going, np.int64)
        for i, t in enumerate(toks):
            out[i] = t.astype("<u4").tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes words not met before."""
        for long in (False, True):
            batch: list[str] = []
            held = 0

            def flush(long=long):
                for w, ids in zip(batch, self._walk([w.encode() for w in batch], long), strict=True):
                    self.known[w] = ids

            for w in words:
                raw = w.encode()
                if (len(raw) > SHORT) != long:
                    continue
                whole = self.ranks.get(raw)
                if whole is not None:
                    self.known[w] = np.array([whole], "<u4").tobytes()
                    continue
                batch.append(w)
                held += len(raw)
                if held > WORD_BYTES:
                    flush()
                    batch, held = [], 0
            if batch:
                flush()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.words.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.aside = {}, self.known
        met = {w for words in cut for w in words if w not in self.known}
        again = {w: self.aside[w] for w in met if w in self.aside}
        self.known.update(again)
        if len(again) < len(met):
            self.learn(met - again.keys())
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of packed ids; long sequences go in pieces."""
        out: list[list[bytes]] = [[] for _ in packed]
        ids = [np.frombuffer(p, "<u4") for p in packed]
        batch: list[tuple[int, np.ndarray]] = []

        def flush():
            lengths = np.array([len(x) for _, x in batch])
            total = int(lengths.sum())
            rows = pa.table(  # noqa: F841
                {"piece": np.repeat(np.arange(len(batch), dtype=np.int32), lengths), "pos": np.arange(total, dtype=np.int32), "tok": np.concatenate([x for _, x in batch]).astype(np.int32)}
            )
            found = self.db.execute("SELECT piece, count(*) AS n, string_agg(txt, '' ORDER BY pos) AS txt FROM rows JOIN vocabulary USING (tok) GROUP BY piece ORDER BY piece").fetchall()
            for piece, n, txt in found:
                i, x = batch[piece]
                if n != len(x):
                    raise ValueError("an id isn't in the vocabulary")
                out[i].append(txt.replace("Ā", "\0").encode("latin-1"))
            if len(found) != len(batch):
                raise ValueError("an id isn't in the vocabulary")

        held = 0
        for i, x in enumerate(ids):
            for at in range(0, len(x), TOKENS):
                batch.append((i, x[at : at + TOKENS]))
                held += len(batch[-1][1])
                if held >= TOKENS:
                    flush()
                    batch, held = [], 0
        if batch:
            flush()
        return [b"".join(parts) for parts in out]


_codecs: dict[str, Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    """One per Python worker and tokenizer."""
    name = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(raw, pattern)
    return _codecs[name]


def _parts(column: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, list]]:
    """(first row, values) of runs of about ``size`` bytes."""
    first, held, part = 0, 0, []
    for i, v in enumerate(column):
        part.append(v.as_py())
        held += len(part[-1] or "")
        if held >= size:
            yield first, part
            first, held, part = i + 1, 0, []
    if part:
        yield first, part


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``n_tokens`` and ``tokens`` (ids as little-endian unsigned 32-bit integers) added.

    With ``decoded``, also the bytes that the ids decode to, made from the ids alone in the same task.
    The pattern's matches are encoded separately, without special tokens; what it doesn't match is left
    out. Null and empty texts have no tokens. Columns of ``docs`` that bear one of the added names are
    replaced; repeated rows are encoded alike; an empty table gives an empty result.

    Scale: narrow, one pass. The rank file is read once, by the driver, and broadcast; its size doesn't depend
    on the data and is checked.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read(32_000_001)
    if len(raw) > 32_000_000:
        raise ValueError("a rank file of over 32 MB isn't broadcast")
    held = docs.sparkSession.sparkContext.broadcast(raw)
    made = ["n_tokens", "tokens", *(["decoded"] if decoded else [])]
    given = [c for c in docs.columns if c not in made]
    source = docs.select(*given)
    at = given.index(text_col)
    schema = ", ".join(["n_tokens long", "tokens binary", *(["decoded binary"] if decoded else [])])
    from pyspark.sql.types import StructType

    full = StructType(source.schema.fields + StructType.fromDDL(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for batch in batches:
            for first, texts in _parts(batch.column(at)):
                packed = codec.encode([t or "" for t in texts])
                columns = [*batch.slice(first, len(texts)).columns, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array(codec.decode(packed), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in full.fields])

    return source.mapInArrow(run, full)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, tokens_col: str = "tokens") -> DataFrame:
    """Every row with ``decoded`` added: the bytes of its packed ids. Null ids stay null."""
    with open(ranks_path, "rb") as f:
        held = encoded.sparkSession.sparkContext.broadcast(f.read())
    from pyspark.sql.types import StructType

    given = [c for c in encoded.columns if c != "decoded"]
    source = encoded.select(*given)
    at = given.index(tokens_col)
    full = StructType(source.schema.fields + StructType.fromDDL("decoded binary").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for batch in batches:
            for first, packed in _parts(batch.column(at)):
                found = codec.decode([p or b"" for p in packed])
                rows = batch.slice(first, len(packed))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([None if p is None else d for p, d in zip(packed, found, strict=True)], pa.binary())], names=[f.name for f in full.fields])

    return source.mapInArrow(run, full)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of ``tokens`` and ``decoded``."""
    return encoded.select(id_col, "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
