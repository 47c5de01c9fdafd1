"""What the operators share: staged tables, input columns, exact tokenizer memo."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"
#: Spark removes a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (tests in local mode) a folder of this
    machine is chosen and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="loomtrace-")
        if not held.isDefined():
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomtrace/{uuid.uuid4().hex}-{name}"


#: Paths of the tables staged inside of ``passing``.
_PASSING: list[list[str]] = []


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: work after it survives lost executors without
    repeating what came before. Once the table is written, its shuffle files are of
    no use and go at once, not when the driver happens to collect its garbage.
    ``keep`` says that it outlives the innermost ``passing``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    for held in _PASSING[-2:-1] if keep else _PASSING[-1:]:
        held.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Remove all tables that were staged under the shared folder; DataFrames that still read them cannot be used any more."""
    _remove(spark, f"{shared_dir(spark)}/loomtrace")


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession):
    """Tables staged inside go at the end, as many as are left in the list of their paths that this gives."""
    held: list[str] = []
    _PASSING.append(held)
    try:
        yield held
    finally:
        _PASSING.remove(held)
        for path in held:
            _remove(spark, path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text as (doc_id long, text string), null text as empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


#: The words that this Python worker remembers just now, of whichever operator.
_REMEMBERED: list[dict] = []


def remember(own: dict | None = None) -> None:
    """Tasks say here what their operator remembers; what another one has left goes.

    Spark gives one worker after another operator's tasks. If it kept the words of
    each, they would add up over a pipeline, and over all workers of an executor.
    Memory that the last task has freed goes back to the system as well.
    """
    for held in _REMEMBERED:
        if held is not own:
            held.clear()
    _REMEMBERED[:] = [] if own is None else [own]
    _trim()


def _trim() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def portions(batches, rows: int = 1000):
    """Arrow batches in slices of some rows, so that few texts at a time become Python's."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def split_words(column) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of texts (A-Z in lower case, split at ASCII white space; null is empty) as ``text.lower().split()`` gives them for bytes.

    Returns the distinct words, the number among these of each word of all texts in
    order, and how many words each text has. Arrow does it: no word of a text
    becomes Python's, only the distinct ones do.
    """
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    # the kernels look at ASCII only, so texts need not be valid
    text = column.view(pa.large_string() if large else pa.string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    coded = parts.flatten().dictionary_encode()
    _, ends, held = coded.dictionary.buffers()
    ends, held = np.frombuffer(ends, np.int64 if large else np.int32)[: len(coded.dictionary) + 1].tolist(), held.to_pybytes() if held else b""
    words, number = [held[i:j] for i, j in zip(ends, ends[1:])], np.asarray(coded.indices)
    offsets = np.asarray(parts.offsets)
    if b"" in words:  # beside white space at the ends of a text
        keep = number != words.index(b"")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        number = number[keep]
    return words, number, np.diff(offsets).astype(np.int64)


#: Letters that the tokenizer keeps together as one word, and what it takes as one piece after them.
_FORMED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch
#: str.split() takes these as white space, the tokenizer's pattern does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_MEMOS: dict[str, "WordMemo"] = {}


class WordMemo:
    """Exact ids of whole texts from the tokenizers library, each distinct word encoded once.

    The library splits this vocabulary's texts at white space before any merge,
    so the ids of a text are those of its words in order, and letters are split
    from signs behind them. So letters, lower-cased, go to the library's model as
    they are, without its normalizer and patterns; all else goes through the whole library.
    Texts with special tokens or with controls that Python alone calls white space
    go to the library uncut. At ``most`` words the later half goes, so the memo's
    memory is bounded.
    """

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.most, self.words, self.tokenize = most, {}, self.tok.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.formed = all(self._cores([c.lower()])[0] + self.direct(t) == self.direct(c + t) for c in ("hello", "Straßenbahn", "ÉTÉ", "ñandú") for t in ("", ".", ",", "'", "!?", "***,"))
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.mergeable = all(self.tok.encode(f"a{s}b c", add_special_tokens=False).ids == self.tok.encode(f"a{s}b", add_special_tokens=False).ids + self.tok.encode("c", add_special_tokens=False).ids for s in ("", ".", "1", "'s"))

    @classmethod
    def at(cls, path: str, most: int = 900_000) -> WordMemo:
        """One memo for each Python worker and vocabulary."""
        remember(_MEMOS)
        if path not in _MEMOS:
            _MEMOS[path] = cls(path)
        _MEMOS[path].most = most
        return _MEMOS[path]

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cores(self, cores: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters."""
        tokenize, signs, flat, stops = self.tokenize, self.signs, [], [0]
        for c in cores:
            flat += [x.id for x in tokenize(c if c.isascii() else c.translate(signs))]
            stops.append(4 * len(flat))
        raw = np.asarray(flat, "<u4").tobytes()
        return [raw[i:j] for i, j in zip(stops, stops[1:])]

    def _learn(self, missing: set[str]) -> bool:
        """Takes words that are not held; tells whether others went for them."""
        # the words that came first are the common ones: they stay
        full = len(self.words) + len(missing) > self.most
        if full:
            self.words = dict(islice(self.words.items(), max(0, min(self.most // 2, self.most - len(missing)))))
        words, formed, cores, odd = self.words, [], set(), set()
        for w in missing if self.formed else ():
            if w.isascii() and w.isalpha() and w.islower():  # most are; such a word is its own core
                cores.add(w)
            elif found := _FORMED(w):
                core, tail = found[1].lower(), found[2]
                formed.append((w, core, tail))
                if core not in words:
                    cores.add(core)
                if tail and tail not in words:
                    odd.add(tail)
            else:
                odd.add(w)
        if not self.formed:
            odd = missing
        todo = list(cores)
        for at in range(0, len(todo), 5000):
            words.update(zip(todo[at : at + 5000], self._cores(todo[at : at + 5000])))
        todo = list(odd)
        for at in range(0, len(todo), 500):
            for w, e in zip(todo[at : at + 500], self.tok.encode_batch_fast(todo[at : at + 500], add_special_tokens=False)):
                words[w] = np.asarray(e.ids, "<u4").tobytes()
        for w, core, tail in formed:
            words[w] = words[core] + words[tail] if tail else words[core]
        return full

    def encode_many(self, texts: list[str], chars: int = 1_000_000):
        """Ids of each whole text, little-endian unsigned 32-bit; about ``chars`` characters are split at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= chars):
                size += len(texts[end]) + 1
                end += 1
            some = texts[at:end]
            whole = [not self.mergeable or len(t) > 50 * chars or _ODD_SPACE.search(t) is not None or any(s in t for s in self.special) for t in some]
            split = [[] if w else t.split() for t, w in zip(some, whole)]
            distinct = set().union(*split)
            fits = True
            for _ in range(2):  # the second time for words that made room for others
                missing = distinct.difference(self.words)
                fits = not missing or not self._learn(missing)
                if fits:
                    break
            words = self.words
            fits = fits or distinct <= words.keys()
            for t, w, s in zip(some, whole, split):
                if w:
                    yield self.direct(t)
                elif fits:
                    yield b"".join([words[x] for x in s])
                else:  # more distinct words than may be held
                    yield b"".join([words[x] if x in words else self.direct(x) for x in s])
            at = end

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))
