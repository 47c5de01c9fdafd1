"""Token counts of whole texts; huge texts by overlap resynchronisation."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, portions, texts, tokenizer_path


def spliced_count(tok, text: str, chunk: int = 32_768, overlap: int = 512) -> int:
    """Tokens of ``text``, encoded in overlapping chunks and spliced.

    Consecutive chunks share ``overlap`` characters. A place is a proven common
    boundary where white space lies in the shared part and both encodings have
    no token across it: this tokenizer never merges across white space, so on
    either side the whole text's ids are the chunk's. If the shared part has no
    such place, the overlap is doubled, until the rest of the text is one chunk.
    """
    n, begin, total = len(text), 0, 0
    while True:
        size = chunk
        wide = overlap
        while True:
            end = min(n, begin + size)
            here = tok.encode(text[begin:end], add_special_tokens=False)
            if end == n:
                return total + len(here.ids)
            lo = max(begin + 1, end - wide)
            after = tok.encode(text[lo : min(n, end + wide)], add_special_tokens=False)
            spans = [(a + begin, b + begin) for a, b in here.offsets]
            cut = _common(text, lo, end, spans, [(a + lo, b + lo) for a, b in after.offsets], here.ids, after.ids)
            if cut is not None:
                total += sum(1 for a, _ in spans if a < cut)
                begin = cut
                break
            wide *= 2
            if wide >= size:
                size *= 2


def _common(text, lo, end, first, second, ids1, ids2):
    """The last place of white space in [lo, end) up to which, from some earlier such place, both encodings agree."""
    left = {}
    for (a, b), i in zip(first, ids1):
        if a >= lo:
            left[a] = (b, i)
    right = {a: (b, i) for (a, b), i in zip(second, ids2)}
    run, cut = 0, None
    for a in sorted(left):
        if right.get(a) == left[a]:
            run += 1
            b = left[a][0]
            if run >= 4 and b < end - 1 and text[b].isspace() and not "\x1c" <= text[b] <= "\x1f":
                cut = b
        else:
            run = 0
    return cut


def whole_count(memo: WordMemo, text: str, chunk: int) -> int:
    """Tokens of a huge text; the library cuts it at special tokens first, and so it is cut here."""
    if not memo.special:
        return spliced_count(memo.tok, text, chunk)
    parts = re.split("(" + "|".join(map(re.escape, sorted(memo.special, key=len, reverse=True))) + ")", text)
    return len(parts) // 2 + sum(spliced_count(memo.tok, p, chunk) for p in parts[::2] if p)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Null texts are empty: 0 bytes, 0 tokens. Repeated rows give repeated rows,
    null ids stay null, an empty table gives no rows, other columns are ignored.
    Narrow: no shuffle, one Arrow batch and one bounded memo in memory.
    """
    path = path or tokenizer_path()

    def count(batches):
        memo = WordMemo.at(path)
        for b in portions(batches):
            texts_ = b.column(1).to_pylist()
            huge = [len(t) > chunk for t in texts_]
            short = memo.encode_many([t for t, h in zip(texts_, huge) if not h])
            out = [whole_count(memo, t, chunk) if h else len(next(short)) // 4 for t, h in zip(texts_, huge)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    found = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return found.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
