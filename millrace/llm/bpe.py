"""BPE encoding and decoding with content-defined chunk reuse.

A hash over the last bytes before white space cuts a text into chunks, at the same places wherever
the same words occur. A task encodes each distinct chunk once: from its distinct words where the
tokenizer declares that no token crosses white space, else as a whole. What meets at the join of two
chunks is encoded together and apart; where the two differ, the chunks become one, which is
encoded again, and its own joins are judged anew, until every join of the text agrees.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.llm.common import arrow_schema, map_text
from millrace.llm.registry import query, table

CHUNK_WORDS = 16
"""Mean words of a chunk; a power of two."""

WINDOW = 8
"""Bytes the rolling hash looks at."""

CHUNK_CACHE, JOIN_CACHE, WORD_CACHE = 50_000, 100_000, 250_000
"""Entries of a task's caches: chunks and joins are dropped when there are more after a slice, words
are kept for one more generation."""

CACHE_BYTES = 32 << 20
"""Words of more bytes in all start a new generation too."""

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True

JOIN_WORDS = 2
"""Words judged on each side of a join for tokenizers that part text anew at white space."""

HEAD = re.compile(rb"(?:[\t-\r ]*[^\t-\r ]+){0,%d}[\t-\r ]*" % JOIN_WORDS)
PLAIN_PART = re.compile(r"[^\\\[\](){}.*+?^$|\s]+|\[(?:[^\]\\]|\\.)+\]\+?")

STOPS = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _members(part: dict | None, inner: str) -> list[dict]:
    """A step of a tokenizer's file, a sequence taken apart."""
    if not part:
        return []
    return part[inner] if part["type"] == "Sequence" else [part]


def join_kind(settings: dict) -> str | None:
    """What a tokenizer's file lets chunks rely on.

    `words`: words between white space never touch each other, as the tokenizer looks for runs of
    characters other than white space by patterns that see nothing around them. `pattern`: text is
    parted anew where white space begins. `merges`: nothing but pair merges, where tokens that agree
    with their neighbours are the result. None: anything else, whose texts are encoded whole.
    """
    import regex

    for n in _members(settings["normalizer"], "normalizers"):
        spaces = n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
        if n["type"] not in ("NFC", "NFD", "Lowercase") and not spaces:
            return None
    parts = _members(settings["pre_tokenizer"], "pretokenizers")
    if not parts:
        return "merges" if settings["model"]["type"] == "BPE" and not settings["model"]["dropout"] else None
    first = parts[0]
    if first["type"] in ("BertPreTokenizer", "Whitespace", "WhitespaceSplit"):
        return "words"
    if first["type"] == "ByteLevel" and first["use_regex"] and len(parts) == 1:
        return "pattern"
    if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"]:
        return None
    pattern = first["pattern"].get("Regex")
    apart = pattern and all(
        PLAIN_PART.fullmatch(p) and not any(regex.search(p, chr(c)) for c in (32, *range(9, 14)))
        for p in pattern.split("|")
    )
    return "words" if apart else None


class ChunkEncoder:
    """Encodes texts (UTF-8) exactly as the tokenizer does, reusing chunks and words. A value is the
    ids and the tokens, each joined by spaces."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.digits = list(map(str, range(size)))
        added = self.tokenizer.get_added_tokens_decoder()
        # Between words, a special token keeps them apart in one call.
        self.mark = next((i for i, t in added.items() if t.special and not t.normalized), None)
        self.kind = join_kind(json.loads(self.tokenizer.to_str()))
        self.drops_space = self.kind == "words"
        # Spellings that encode alike are made alike, so that more words and chunks are shared.
        letters = bytes(range(97, 123))
        self.folds_case = all(
            self.raw(letters[i:] + letters[:i]) == self.raw((letters[i:] + letters[:i]).upper()) for i in range(26)
        )
        self.parts_stops = self.drops_space and all(
            self.raw(b"%c%s" % (c, stop)) == self.raw(b"%c %s" % (c, stop)) for c in letters for stop in (b".", b",")
        )
        self.special = [t.content.lower().encode() for t in added.values()]
        self.ids: dict[bytes, str] = {}
        self.tokens: dict[bytes, str] = {}
        self.old: tuple[dict, dict] = {}, {}
        self.bytes = 0
        self.chunk_ids: dict[bytes, str] = {}
        self.chunk_tokens: dict[bytes, str] = {}
        self.edges: dict[bytes, tuple[bytes, bytes]] = {}
        self.agrees: dict[tuple[bytes, bytes], bool] = {}

    def _strings(self, ids) -> tuple[str, str]:
        return " ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids])

    def raw(self, text: bytes) -> tuple[str, str]:
        """The whole text in one call."""
        return self._strings(self._ids(text.decode("utf-8")))

    def _ids(self, text: str) -> list[int]:
        """The tokenizer's ids; where the tokens lie in the text is not asked for."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def values(self, texts: list[bytes]) -> list[tuple[str, str]]:
        """Values of texts, each encoded by itself; many in one call where that cannot matter."""
        name = self.names[self.mark] if self.mark is not None and self.drops_space else None
        out = []
        for start in range(0, len(texts), 10_000):
            part = texts[start : start + 10_000]
            joined = name.encode().join(part).decode("utf-8") if name else ""
            if name and joined.count(name) == len(part) - 1:
                ids, tokens = self._strings(self._ids(joined))
                ids, tokens = ids.split(f" {self.mark} "), tokens.split(f" {name} ")
                if len(ids) == len(part) == len(tokens):
                    out += zip(ids, tokens)
                    continue
            # Texts that hold the mark itself, or some without any token.
            out += map(self.raw, part)
        return out

    def learn(self, words: set[bytes]) -> None:
        """Values of words not known yet; afterwards all of them are."""
        if len(self.ids) > WORD_CACHE or self.bytes > CACHE_BYTES:
            self.old = self.ids, self.tokens
            self.ids, self.tokens, self.bytes = {}, {}, 0
        words = words - self.ids.keys()
        for w in words & self.old[0].keys():
            self.ids[w], self.tokens[w] = self.old[0][w], self.old[1][w]
        new = sorted(words - self.old[0].keys())
        self.bytes += sum(map(len, new))
        for w, value in zip(new, self.values(new)):
            self.ids[w], self.tokens[w] = value

    def chunks(self, raw: bytes) -> list[bytes]:
        """Chunks of a text; all but the first begin with white space."""
        if len(raw) <= WINDOW + 1 or self.kind is None:
            return [raw]
        data = np.frombuffer(raw, np.uint8)
        space = SPACE[data]
        starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        starts = starts[starts >= WINDOW]
        words = np.ndarray(len(raw) - WINDOW + 1, "<u8", raw, strides=(1,))[starts - WINDOW]
        with np.errstate(over="ignore"):
            hashed = (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        cuts = starts[hashed % np.uint64(CHUNK_WORDS) == 0].tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]

    def _edges(self, chunk: bytes) -> tuple[bytes, bytes]:
        """What is judged of a chunk at the join before it and at the one behind it."""
        if self.drops_space:
            # Nothing can differ; the characters that meet are encoded all the same.
            text = chunk[:64].lstrip()[:4].decode("utf-8", "ignore"), chunk[-4:].decode("utf-8", "ignore")
            return f" {text[0][:1]}".encode(), text[1][-1:].encode()
        if self.kind == "pattern":
            words = chunk.rsplit(None, JOIN_WORDS)
            return HEAD.match(chunk).group(), chunk[len(words[0]) if len(words) > JOIN_WORDS else 0 :]
        return chunk, chunk

    def prepare(self, raw: bytes) -> bytes | None:
        """The text in the spelling that is shared; None if special tokens may be in it."""
        low = raw.lower()
        if any(t in low for t in self.special):
            return None
        if self.folds_case:
            raw = low
        return STOPS.sub(rb" \1", raw) if self.parts_stops else raw

    @staticmethod
    def _joined(values) -> tuple[str, str]:
        return " ".join(filter(None, (v[0] for v in values))), " ".join(filter(None, (v[1] for v in values)))

    def _know(self, chunks: set[bytes]) -> None:
        """Values and edges of chunks not known yet."""
        new = [c for c in chunks if c not in self.chunk_ids]
        if self.drops_space:
            split = [c.split() for c in new]
            self.learn(set().union(*split))
            ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
            for chunk, words in zip(new, split):
                self.chunk_ids[chunk] = " ".join(filter(None, map(ids, words)))
                self.chunk_tokens[chunk] = " ".join(filter(None, map(tokens, words)))
        else:
            for chunk, value in zip(new, self.values(new)):
                self.chunk_ids[chunk], self.chunk_tokens[chunk] = value
        for chunk in new:
            self.edges[chunk] = self._edges(chunk)

    def _judge(self, joins: set[tuple[bytes, bytes]]) -> None:
        """Whether both sides of joins not judged yet encode alike together and apart."""
        new = [j for j in joins if j not in self.agrees]
        sides = list({x for j in new for x in j})
        apart = dict(zip(sides, self._sides(sides)))
        for (a, b), whole in zip(new, self.values([a + b for a, b in new])):
            self.agrees[a, b] = self._joined((apart[a], apart[b])) == whole

    def _sides(self, sides: list[bytes]) -> list[tuple[str, str]]:
        if not self.drops_space:
            return self.values(sides)
        words = [x.strip() for x in sides]
        self.learn(set(words))
        return [(self.ids[w], self.tokens[w]) for w in words]

    def _joins(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        return [(self.edges[a][1], self.edges[b][0]) for a, b in pairwise(chunks)]

    def _repair(self, chunks: list[bytes]) -> list[bytes]:
        """Chunks whose joins all agree: those at a join that does not are encoded again as one."""
        while True:
            joins = self._joins(chunks)
            self._judge(set(joins))
            groups = [[chunks[0]]]
            for join, chunk in zip(joins, chunks[1:]):
                if self.agrees[join]:
                    groups.append([chunk])
                else:
                    groups[-1].append(chunk)
            if len(groups) == len(chunks):
                return chunks
            chunks = [b"".join(g) for g in groups]
            for chunk, group in zip(chunks, groups):
                if len(group) > 1:
                    self.chunk_ids[chunk], self.chunk_tokens[chunk] = self.raw(chunk)
                    self.edges[chunk] = self._edges(chunk)

    def encode(self, texts: list[bytes]) -> list[tuple[str, str]]:
        """Values of texts; chunks and joins new to the task are encoded together first."""
        made = [self.prepare(x) for x in texts]
        parts = [None if x is None else self.chunks(x) for x in made]
        self._know({c for p in parts if p for c in p})
        joins = [None if p is None else self._joins(p) for p in parts]
        self._judge({j for js in joins if js for j in js})
        agrees = self.agrees.__getitem__
        parts = [p if p is None or all(map(agrees, js)) else self._repair(p) for p, js in zip(parts, joins)]
        ids, tokens = self.chunk_ids.__getitem__, self.chunk_tokens.__getitem__
        out = [
            self.raw(x) if p is None else (" ".join(filter(None, map(ids, p))), " ".join(filter(None, map(tokens, p))))
            for x, p in zip(texts, parts)
        ]
        if len(self.chunk_ids) > CHUNK_CACHE:
            self.chunk_ids, self.chunk_tokens, self.edges = {}, {}, {}
        if len(self.agrees) > JOIN_CACHE:
            self.agrees = {}
        return out


def _size(ids: str) -> int:
    return ids.count(" ") + 1 if ids else 0


def encode(df: DataFrame, row_id: str, text: str, tokenizer: str) -> DataFrame:
    """`row_id`, `ids` (array<int>), `n_tokens` of every row, special tokens not added.

    NULL and empty texts have no ids. Rows are taken one by one, so repeated ids or texts change
    nothing; an empty table gives no rows. No shuffle: a task keeps a bounded number of chunks.
    `tokenizer` is a path every executor can read.
    """
    schema = T.StructType(
        [
            T.StructField(row_id, df.schema[row_id].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    kind = arrow_schema(schema).field("ids").type

    def make():
        encoder = ChunkEncoder(tokenizer)

        def run(piece):
            made = [v[0] for v in encoder.encode(piece[text])]
            ids = [np.fromstring(v, dtype=np.int32, sep=" ") for v in made]
            return {
                row_id: piece[row_id],
                "ids": pa.array(ids, kind),
                "n_tokens": list(map(_size, made)),
            }

        return run

    return map_text(df, [row_id], text, schema, make)


def decode(df: DataFrame, row_id: str, ids: str, tokenizer: str) -> DataFrame:
    """`row_id`, `text`: the tokenizer's own decoding with special tokens kept. NULL ids give an
    empty text."""
    schema = T.StructType(
        [T.StructField(row_id, df.schema[row_id].dataType), T.StructField("text", T.StringType())]
    )
    out = arrow_schema(schema)

    def run(batches):
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(tokenizer)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            for start in range(0, len(batch), 256):
                texts = tool.decode_batch(
                    [x or [] for x in lists.slice(start, 256).to_pylist()], skip_special_tokens=False
                )
                keys = batch.column(batch.schema.get_field_index(row_id)).slice(start, 256)
                yield pa.RecordBatch.from_arrays([keys.cast(out.field(0).type), pa.array(texts, out.field(1).type)], schema=out)

    return df.select(row_id, ids).mapInArrow(run, schema)


def digests(df: DataFrame, row_id: str, text: str, tokenizer: str) -> DataFrame:
    """`row_id`, `n_tokens`, `ids_sha256`, `decoded_sha256` of the same encoding; the ids stay in
    the task. For a tokenizer without a decoder, whose decoding is its tokens joined by spaces;
    others are decoded from their ids."""
    schema = T.StructType(
        [
            T.StructField(row_id, df.schema[row_id].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def make():
        encoder = ChunkEncoder(tokenizer)
        plain = encoder.tokenizer.decoder is None
        sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()

        def text_of(value):
            if plain:
                return value[1]
            return encoder.tokenizer.decode([int(x) for x in value[0].split()], skip_special_tokens=False)

        def run(piece):
            made = encoder.encode(piece[text])
            return {
                row_id: piece[row_id],
                "n_tokens": [_size(v[0]) for v in made],
                "ids_sha256": [sha(v[0]) for v in made],
                "decoded_sha256": [sha(text_of(v)) for v in made],
            }

        return run

    return map_text(df, [row_id], text, schema, make)


@query("op9_chunked_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), "doc_id", "text", default_tokenizer())
