"""Token counts of a BPE model with a whole-token shortcut.

The model splits a text before each run of spaces (none of its pieces holds
a space mark behind another character, which is checked), so a text's count
is the sum over its pre-tokens. Offline, every vocabulary string is encoded
alone; those that come back as one token are proven whole and count 1
without the library. The library merges only the other pre-tokens, each
distinct one once per task as long as its table of recent ones holds it.

Defined cases: a null text is empty and has no tokens; control or special
strings in a text are ordinary text; the mark U+2581 counts as a space, as
the model reads it; very long texts are counted whole; null ids and
repeated rows count like others; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from inquiro.llm.common import share, shared, text_slices

LIMIT = 4096
MARK = "▁"
_PRETOKEN = re.compile(r" +[^ ]*")


def whole_tokens(model_file: str) -> dict[str, int]:
    """Pre-tokens (after their first space) that encode as one token, each
    with its count 1. Refuses a model whose pieces cross a pre-token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds a space inside: its texts can't be split at spaces")
    own = [p[1:].replace(MARK, " ") for p in pieces if p.startswith(MARK) and len(p) > 1]
    return {t: 1 for t, ids in zip(own, model.encode(own)) if len(ids) == 1}


class TokenCounter:
    """Counts of texts; remembers up to `most` merged pre-tokens."""

    def __init__(self, model: bytes, whole: dict[str, int], most: int = 300_000):
        import sentencepiece

        self.model, self.whole, self.most = sentencepiece.SentencePieceProcessor(model_proto=model), whole, most
        self.known = dict(whole)

    @staticmethod
    def pretokens(text: str) -> list[str]:
        """Each without its first space, which the model adds again."""
        text = text.replace(MARK, " ")
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in _PRETOKEN.findall(" " + text)]
        return text.split(" ")

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        if len(self.known) > self.most + len(self.whole):
            self.known = dict(self.whole)
        known = self.known
        new = list({p for s in split for p in s if p not in known})
        # the empty pre-token is a lone space mark: encode "" would give none
        known.update((p, len(ids)) for p, ids in zip(new, self.model.encode(new)) if p)
        known[""] = 1
        return [sum(map(known.__getitem__, s)) for s in split]


def count_tokens(docs: DataFrame, model_file: str, *, limit: int = LIMIT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    with open(model_file, "rb") as f:  # the driver reads the model, tasks get its bytes
        proven = share(docs.sparkSession, (f.read(), whole_tokens(model_file)))  # at most the vocabulary

    def count(batches):
        counter = TokenCounter(*shared(proven))
        for batch in text_slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = counter(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
