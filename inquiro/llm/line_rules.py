"""Line-first cleaning: rules judge each line, failing lines go, and a
document that loses too much of its text is rejected.

Rules of a line (first that fits is its reason):
  navigation   three or more separators, or nothing but menu words
  symbols      over `symbol_share` of its words hold one of #*$%&|<>
  shouting     over half of its words end in a doubled ! or ?
  boilerplate  a phrase of licences, cookie notes, site furniture
  punctuation  fewer than `short` words and no closing punctuation
Lines without a word are neither kept nor counted as loss.

Defined cases: a null text has no words and fails the base rule, as does an
empty one; null ids and repeated rows are judged like others; an empty table
gives no rows; other columns are not read. Each text is read whole; a task
holds one slice of about 4 MB of texts.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from inquiro.llm.common import text_slices

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SHOUT = re.compile(r"[!?]{2}[.,;:]?(?=[\x20\x09-\x0D]|$)")
_SEPARATOR = re.compile(r"[|»›•·]|(?<=\s)[>/](?=\s)")
_CLOSING = re.compile(r"[.!?…:;。！？\"'”’»)\]]\s*$")
_MENU = frozenset("home login logout register about contact menu search next previous prev back top sitemap share tweet print help faq news shop cart account settings more subscribe".split())
_BOILERPLATE = re.compile(
    r"all rights reserved|licen[sc]ed under|released under the|under the terms of the|terms of (?:use|service)|privacy policy|cookie polic|uses cookies|accept (?:all )?cookies|enable javascript|lorem ipsum|click here|sign up for|powered by|copyright ©|©\s*\d{4}",
    re.IGNORECASE,
)


def line_reason(line: str, *, symbol_share: float = 0.3, short: int = 4) -> str | None:
    """Why a line with words fails, or None."""
    words = [w for w in _SPACE.split(line) if w]
    if len(_SEPARATOR.findall(line)) >= 3 or all(w.strip(".,:>|").lower() in _MENU for w in words):
        return "navigation"
    marked = sum(1 for w in words if _SYMBOL.search(w)) if _SYMBOL.search(line) else 0
    if marked > symbol_share * len(words):
        return "symbols"
    if len(_SHOUT.findall(line)) * 2 > len(words):
        return "shouting"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    if len(words) < short and not _CLOSING.search(line):
        return "punctuation"
    return None


def clean_text(text: str, *, symbol_share: float = 0.3, short: int = 4) -> tuple[str, int, int, list[str]]:
    """(remaining text, characters judged, characters lost, reasons)."""
    kept, judged, lost, reasons = [], 0, 0, []
    for line in text.split("\n"):
        if not line.strip(" \t\r\v\f"):
            continue
        judged += len(line)
        if why := line_reason(line, symbol_share=symbol_share, short=short):
            lost += len(line)
            reasons.append(why)
        else:
            kept.append(line)
    return "\n".join(kept), judged, lost, reasons


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a window that occurs twice or more in the text."""
    grams = list(zip(*(words[i:] for i in range(window))))
    times = Counter(grams)
    if len(times) == len(grams):
        return 0
    covered, end = 0, 0
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def base_metrics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = [w for w in _SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def clean_documents(docs: DataFrame, *, max_loss: float = 0.5, symbol_share: float = 0.3, short: int = 4, with_text: bool = True) -> DataFrame:
    """Judge and clean every row of docs(doc_id, text).

    Returns doc_id, the base metrics, base_failed, kept, n_lines_removed,
    lost_chars and, if asked, the cleaned text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches):
        for batch in text_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                n = base_metrics(text)
                failed = n[0] < MIN_WORDS or 100 * n[4] > MAX_REPEAT_PERCENT * n[0]
                left, judged, lost, reasons = clean_text(text, symbol_share=symbol_share, short=short)
                rows.append((*n, failed, not failed and lost <= max_loss * judged, len(reasons), lost, *([left] if with_text else [])))
            columns = list(zip(*rows))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names, "base_failed", "kept", "n_lines_removed", "lost_chars", *(["clean_text"] if with_text else [])])

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, n_lines_removed long, lost_chars long" + ", clean_text string" * with_text
    return docs.select("doc_id", "text").mapInArrow(judge, schema)
