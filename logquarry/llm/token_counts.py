"""Token counts by the whole-token shortcut, for a SentencePiece BPE model.

Offline, the model's vocabulary is searched for the strings that encode alone as one token, and for proof that no piece
reaches over a pre-token's border: none holds a space mark after another character, none holds a line break, and the
normaliser changes nothing but spaces. Then a text's count is the sum over its pre-tokens, matching pre-tokens count
one, and only the rest are merged by the library. A model without that proof has its whole texts encoded.

Defined cases: a null text counts as empty and has 0 tokens; repeated rows each have a row; an empty table gives an
empty result; further columns play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import table

MARK = "▁"
LIMIT = 4096
#: Counts of merged pre-tokens a worker keeps.
MEMO = 400_000
#: Characters whose pre-tokens are held at once.
BATCH_CHARS = 1 << 20


def borders_proved(proto) -> bool:
    """Whether no piece of a model reaches over a space that follows another character, or over a line break."""
    norm, train = proto.normalizer_spec, proto.trainer_spec
    return (
        train.model_type == train.BPE
        and not norm.precompiled_charsmap
        and norm.add_dummy_prefix
        and norm.escape_whitespaces
        and not norm.remove_extra_whitespaces
        and not train.treat_whitespace_as_suffix
        and not any(p.type == p.USER_DEFINED for p in proto.pieces)
        and not any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in proto.pieces if p.type == p.NORMAL)
    )


def pre_tokens(text: str) -> list[list[str]]:
    """The pre-tokens of a text's lines; each but a line's first begins with its spaces, and the text with one more."""
    lines = []
    for line in (" " + text).split("\n") if text else []:
        parts = line.split(" ")
        if "" in parts[1:]:
            lines.append(_spaced(line))
        else:
            lines.append([parts[0]] * bool(parts[0]) + [" " + w for w in parts[1:]])
    return lines


class PieceCounter:
    """Counts the tokens of texts as sentencepiece does."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        normal = [p.piece for p in proto.pieces if p.type == p.NORMAL]
        self.proved = borders_proved(proto)
        self.memo: dict[str, int] = {}
        if not self.proved:
            return
        # "\n" borders on both sides, so what follows it is encoded as if alone, without the prefix a text's start gets.
        self.newline = len(self.model.encode("\n")) - 1
        words = [p[1:] for p in normal if p[0] == MARK and p[1:] and MARK not in p[1:]]
        self.single = {" " + w for w, ids in zip(words, self.model.encode(words, num_threads=1)) if len(ids) == 1}
        inner = [p for p in normal if MARK not in p]
        lead = 1 + self.newline
        self.single |= {w for w, ids in zip(inner, self.model.encode(["\n" + w for w in inner], num_threads=1)) if len(ids) == lead + 1}
        self.memo = dict.fromkeys(self.single, 1)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.proved:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        out: list[int] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                out += self._by_words(group)
                group, size = [], 0
        return out + self._by_words(group)

    def _by_words(self, texts: list[str]) -> list[int]:
        lines = [pre_tokens(t.replace(MARK, " ")) for t in texts]
        words = [list(chain.from_iterable(own)) for own in lines]
        self._learn(words)
        get = self.memo.__getitem__
        return [sum(map(get, own)) + self.newline * max(0, len(parts) - 1) for own, parts in zip(words, lines)]

    def _learn(self, words: list[list[str]]) -> None:
        new: set[str] = set()
        for own in words:
            new.update(own)
        if len(self.memo) + len(new) > MEMO:
            self.memo = dict.fromkeys(self.single, 1)
        rest = list(new.difference(self.memo))
        lead = 1 + self.newline
        self.memo.update(zip(rest, (len(x) - lead for x in self.model.encode(["\n" + w for w in rest], num_threads=1))))


def _spaced(part: str) -> list[str]:
    """Pre-tokens of a line with runs of spaces: each run goes with the characters after it."""
    out, at = [], 0
    while at < len(part):
        end = at
        while end < len(part) and part[end] == " ":
            end += 1
        stop = part.find(" ", end)
        stop = len(part) if stop < 0 else stop
        out.append(part[at:stop])
        at = stop
    return out


@functools.lru_cache(maxsize=2)
def piece_counter(model_file: str) -> PieceCounter:
    """One for each Python worker, which keeps its memo from task to task."""
    return PieceCounter(model_file)


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = piece_counter(model_file)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": counter.counts(list(pdf["text"]))})

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInPandas(
        count, "doc_id long, n_bytes long, n_tokens long"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
