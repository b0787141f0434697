"""Token ids as Parquet list columns, readable by document and by column.

The file format is a folder of Parquet files sorted by document id: ``tokens`` is a list column in
dictionary encoding (a token vocabulary fits one dictionary page), the ids and offsets are delta
encoded, row groups and pages have stated sizes, and the page indexes that the writer adds let a
filter on ``doc_id`` skip pages and a metadata query skip the token column.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

GAP = re.compile(r"\s ")
SPACES = re.compile(r"\s\s|^\s|\s$")
CUT = re.compile(r"(?<=\S)(?= )")
#: What Python takes for white space; Arrow's own class has less.
SPACE = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "]"

#: Bytes of texts that are encoded together, besides the last of them.
TOGETHER = 2 << 20
#: Words after which the table of those after a space starts anew (the other one: a third), and the greatest length of a word.
LIMIT, LONGEST = 300_000, 40
#: New words that the model gets at once; it holds about a kilobyte for each of them meanwhile.
AT_ONCE = 4096
#: Below this code point every library agrees on what a letter is.
LETTERS = "\u0530"
#: A word of such letters and some marks, which are a piece of their own; no apostrophe, which may belong to letters.
MARKED = r"^(?P<word>[L]+)(?P<marks>[M]{1,4})$"
#: Two words of letters, with marks or without, and a line feed between them, which is a piece of its own too.
FED = r"^(?P<word>[L]+)(?P<marks>[M]{0,4})\n(?P<next>[L]+)(?P<last>[M]{0,4})$"
MARKED, FED = (
    x.replace("[L]", "[" + "".join(chr(c) for c in range(ord(LETTERS)) if chr(c).isalpha()) + "]").replace("[M]", r"[!-&(-/:-@\[-`{-~]")
    for x in (MARKED, FED)
)

SCHEMA = "doc_id long, shard int, seq long, shard_start long, n_tokens int, tokens array<int>"


def byte_level(file: dict) -> bool:
    """Whether a tokenizers file is a plain byte-level BPE, whose texts may be cut before spaces."""
    step, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    return (
        file.get("normalizer") is None
        and step.get("type") == "ByteLevel"
        and not step.get("add_prefix_space")
        and step.get("use_regex", True)
        and model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and all(t.get("special") for t in file.get("added_tokens") or [])
    )


def of_letters(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < LETTERS)


class Words(dict):
    """Word -> the ids of ``before`` + word as bytes; what isn't known yet is encoded.

    A full table becomes ``older``, and of an older one those words stay that come again meanwhile. Only short words
    are remembered, so that twice the limit, and those of texts encoded together, is a bound in bytes too.
    """

    def __init__(self, encoder: Encoder, before: str):
        self.encoder, self.before, self.older = encoder, before, {}

    def keep(self, words: list[str], ids: list[bytes]) -> None:
        if words and max(map(len, words)) > LONGEST:
            short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
            words, ids = [words[i] for i in short], [ids[i] for i in short]
        self.update(zip(words, ids, strict=True))
        if len(self) >= (LIMIT if self.before else LIMIT // 3):
            self.older = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        if word in self.older:
            ids = self.older[word]
        elif of_letters(word):
            ids = self.encoder.model_ids(self.before + word)
        elif word[:-1].isalpha() and word[-1] in ",.:;!?":
            return self[word[:-1]] + self.encoder.mark(word[-1])  # not kept: both parts are
        elif "\n" in word and not SPACES.search(word):
            # a single line feed between two words is a piece of its own; not kept either
            head, *lines = word.split("\n")
            feed, bare = self.encoder.mark("\n"), self.encoder.bare
            return self[head] + b"".join([x for line in lines for x in (feed, bare[line])])
        else:
            ids = self.encoder.whole(self.before + word)
        self.keep([word], [ids])
        return ids


class Encoder:
    """Encodes texts with a tokenizers file, remembering what each word after a space gave.

    A space after a character that isn't white space always starts a new piece in a byte-level
    tokenizer, so a text may be cut there and each part encoded alone. Words of letters go to the
    tokenizer's model directly, everything else through the whole tokenizer. A file with any other
    normalizer, pre-tokenizer, model or ordinary added tokens is used on whole texts alone, and so is
    any file on a text that holds the content of one of its added tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.plain = byte_level(file)
        # a text that spells an added token out gets that token's id, which words alone wouldn't show
        added = [t["content"] for t in file.get("added_tokens") or [] if t.get("content")]
        self.spelled = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        # Byte-level models read bytes as printable characters: those that print stand for
        # themselves, the others take the code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.table = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.words, self.bare, self.marks = Words(self, " "), Words(self, ""), {}
        # many words at once: the model gets them as they are, and the bytes of its tokens tell where words end
        self.many, vocabulary = Tokenizer(self.model), self.tokenizer.get_vocab()
        self.token_sizes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.token_sizes[i] = len(token)
        self.whole_bytes = self.plain and all(chr(c) in vocabulary for c in self.table.values())

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def model_ids(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def mark(self, char: str) -> bytes:
        if char not in self.marks:
            if len(self.marks) >= 1 << 16:
                self.marks.clear()
            self.marks[char] = self.whole(char)
        return self.marks[char]

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not self.plain or self.spelled(text):
            return self.whole(text)
        if GAP.search(text):
            head, *rest = CUT.split(text)
            rest = [x[1:] for x in rest]
        else:
            head, *rest = text.split(" ")
        return self.bare[head] + b"".join(map(self.words.__getitem__, rest))

    def words_of_letters(self, before: str, words: list[str]) -> list[bytes]:
        """The ids of ``before`` and each of ``words``, which are of letters alone."""
        shown = f"\n{before}".join(["", *words]).encode().decode("latin-1").translate(self.table).split(chr(self.table[10]))[1:]
        found = self.many.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids
        ids = np.array(found, dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.token_sizes[ids]), np.cumsum(list(map(len, shown)))) + 1
        coded, at = ids.tobytes(), 0
        return [coded[at : (at := end)] for end in (4 * ends).tolist()]

    def look_up(self, known: Words, words: list[str]) -> list[bytes]:
        """The ids that ``known`` has or gets for each of ``words``, none of which comes twice."""
        coded = list(map(known.get, words))
        new = [i for i, x in enumerate(coded) if x is None]
        if known.older:
            found = list(map(known.older.get, [words[i] for i in new]))
            again = [i for i, x in zip(new, found, strict=True) if x is not None]
            for i, x in zip(new, found, strict=True):
                coded[i] = x
            new = [i for i in new if coded[i] is None]
            known.keep([words[i] for i in again], [coded[i] for i in again])
        letters = [i for i in new if of_letters(words[i])] if self.whole_bytes else []
        for at in range(0, len(letters), AT_ONCE):
            here = letters[at : at + AT_ONCE]
            some = [words[i] for i in here]
            ids = self.words_of_letters(known.before, some)
            known.keep(some, ids)
            for i, x in zip(here, ids, strict=True):
                coded[i] = x
        for i in new:
            if coded[i] is None:
                coded[i] = known[words[i]]
        return coded

    def encode_all(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with those of ``end`` behind it, and how many that are for each.

        Every different word of the texts is looked up once, and ids are gathered by the words' numbers.
        """
        gaps = pc.match_substring_regex(pa.array(texts, pa.string()), GAP.pattern.replace(r"\s", SPACE)).to_pylist()
        alone = [not self.plain or gap or bool(self.spelled(t)) for t, gap in zip(texts, gaps, strict=True)]
        split = pc.split_pattern(pa.array(["" if x else t for t, x in zip(texts, alone, strict=True)], pa.string()), " ")
        starts = split.offsets.to_numpy()[:-1]
        # first words have no space before them; a text that is encoded alone is a single piece, and so is what ends texts
        first = [self.encode(t) if x else self.bare[t.partition(" ")[0]] for t, x in zip(texts, alone, strict=True)]
        found = split.values.dictionary_encode()
        parted = pc.extract_regex(found.dictionary, MARKED)
        of = {"word": pc.coalesce(pc.struct_field(parted, "word"), found.dictionary), "marks": pc.fill_null(pc.struct_field(parted, "marks"), "")}
        at = np.flatnonzero(pc.match_substring(found.dictionary, "\n").to_numpy(zero_copy_only=False))
        parted = pc.extract_regex(found.dictionary.take(pa.array(at)), FED)
        at, parted = at[parted.is_valid().to_numpy(zero_copy_only=False)], parted.drop_null()
        fed = np.zeros(len(found.dictionary), dtype=bool)
        fed[at] = True
        for name in ("word", "marks"):
            of[name] = pc.replace_with_mask(of[name], pa.array(fed), pc.struct_field(parted, name))
        # columns of a word, its marks, and for some a line feed, another word and its marks; the first of ``coded`` is nothing
        coded, columns = [b"", self.mark("\n")], np.zeros((len(fed), 5), dtype=np.int64)
        columns[at, 2] = 1
        for to, name, rows in ((0, "word", slice(None)), (1, "marks", slice(None)), (3, "next", at), (4, "last", at)):
            parts = (of[name] if name in of else pc.struct_field(parted, name)).dictionary_encode()
            columns[rows, to] = parts.indices.to_numpy() + len(coded)
            some = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
            known = {"word": self.words, "next": self.bare}.get(name)
            coded += map(self.mark, some) if known is None else self.look_up(known, some)
        known, sizes = gather(coded, columns.ravel())
        coded, ends = known.tobytes(), 4 * np.cumsum(sizes.reshape(-1, 5).sum(axis=1))
        n = len(ends)
        pieces = np.array(found.indices)
        pieces[starts] = np.arange(n, n + len(first), dtype=pieces.dtype)
        pieces = np.insert(pieces, split.offsets.to_numpy()[1:], n + len(first))
        ids, sizes = gather([coded, *first, end], pieces, ends)
        return ids, np.add.reduceat(sizes, starts + np.arange(len(starts)))


def gather(coded: list[bytes], pieces: np.ndarray, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``pieces``, numbers in ``coded``, one after another, and how many each has.

    ``parts``: where the pieces end that the first of ``coded`` consists of.
    """
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    ends = np.cumsum(sizes) if parts is None else np.concatenate([parts, np.cumsum(sizes)[1:]])
    starts = np.concatenate([[0], ends]) // 4
    lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
    return lists.take(pa.array(pieces)).flatten().to_numpy(), np.diff(starts)[pieces]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 128 << 10,
) -> None:
    """Encode every whole text and write the token files below ``path`` in ascending document order.

    ``tokenizer``: a tokenizers JSON file that every executor has. ``end_id`` ends each document.
    Null text is empty (the end id alone); null ids come first; rows with equal ids all stay, in the
    order of their texts; other columns of ``docs`` aren't read. An empty table gives no rows.
    Documents are dealt to tasks by ranges of ids, so no task holds more than its range.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, seq, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            before_text = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()) // TOGETHER
            cuts = sorted({0, *(np.flatnonzero(np.diff(before_text)) + 1).tolist(), batch.num_rows})
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(at, to - at)
                ids, n = enc.encode_all([t or "" for t in part.column(1).to_pylist()], end)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.full(k, shard, dtype=np.int32)),
                        pa.array(np.arange(seq, seq + k)),
                        pa.array(before + ends - n),
                        pa.array(n.astype(np.int32)),
                        lists,
                    ],
                    names=["doc_id", "shard", "seq", "shard_start", "n_tokens", "tokens"],
                )
                seq, before = seq + k, before + int(ends[-1])

    (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token files; column pruning and filters on ``doc_id`` reach the Parquet pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def shard_starts(tokens: DataFrame) -> DataFrame:
    """(shard, before): how many ids stand in all earlier shards. One row a file, so always small."""
    sums = tokens.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def token_digest(tokens: DataFrame) -> DataFrame:
    """Per document of the token files: its id, its place in the stream of all ids, number and CRC-32 of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
            )

    digests = tokens.select("doc_id", "shard", "tokens", "shard_start").mapInArrow(
        run, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long"
    )
    return digests.join(F.broadcast(shard_starts(tokens)), "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_table(docs: DataFrame, tokenizer: str, end_id: int, **names: str) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return them."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, **names)
    return read_tokens(docs.sparkSession, path)
