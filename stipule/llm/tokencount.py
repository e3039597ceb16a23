"""Token counts by unigram segmentation, shared over a trie of pre-tokens.

A text splits at white space into pre-tokens; each gets a leading word mark.
The lexicon's pieces have log probabilities, and a pre-token's tokens are those
of its most probable segmentation.  Each task inserts its distinct pre-tokens in
a trie.  A node's forward score, the best over all segmentations of the prefix
it stands for, depends on its ancestors only, so every shared prefix is scored
once; the node where a pre-token ends stores that pre-token's count.

The lexicon is the piece list of a public tokenizer file, which has ranks but no
probabilities.  Its order is by frequency, and log probabilities follow Zipf's law
over it: nothing is trained, so counts are those of this lexicon, not the file's own.
Scores are whole numbers, so sums do not depend on their order.  Of equally
probable segmentations the one of fewest tokens counts.  A character without a
piece costs its UTF-8 bytes, one token each.

Defined results: null and empty texts have no pre-tokens and no tokens; a null
id passes through; repeated rows give repeated results; other columns are
ignored; a pre-token beyond ``LONG`` characters is scored on its own, in the
same way, instead of entering the trie, so a task holds at most ``NODES`` nodes
and those of one more text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stipule.llm.common import arrow_map, table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SCALE, ZIPF_SHIFT, BYTE_PENALTY = 1_000_000, 2.7, 10
#: Trie nodes after which a task drops its trie, between texts, and begins anew.
NODES, LONG = 500_000, 256


class Lexicon(NamedTuple):
    """Scaled log probability of each piece, and that of a byte token."""

    scores: dict[str, int]
    byte_score: int


def lexicon(pieces: Iterable[str]) -> Lexicon:
    """Zipf scores for pieces given by falling frequency; repeats keep the first."""
    order = list(dict.fromkeys(p for p in pieces if p))
    total = math.log(sum(1 / (k + ZIPF_SHIFT) for k in range(len(order)))) if order else 0.0
    scores = {p: round(SCALE * (-math.log(k + ZIPF_SHIFT) - total)) for k, p in enumerate(order)}
    return Lexicon(scores, min(scores.values(), default=0) - BYTE_PENALTY * SCALE)


def load(path: str = TOKENIZER) -> Lexicon:
    """The lexicon of a SentencePiece file: its ordinary pieces by their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return lexicon(model.id_to_piece(i) for i in ids)


class Counter:
    """Token counts of pre-tokens, with a trie of those met so far."""

    def __init__(self, lex: Lexicon, nodes: int = NODES) -> None:
        self.byte_score, self.limit = lex.byte_score, nodes
        # Pieces from their last character backwards; key "" holds a whole piece's score.
        self.endings: dict = {}
        for piece, score in lex.scores.items():
            at = self.endings
            for char in reversed(piece):
                at = at.setdefault(char, {})
            at[""] = score
        self.clear()

    def clear(self) -> None:
        """Forget the trie and the stored counts."""
        self.children: dict[int, int] = {}  # node and character to node; node 0 is the empty prefix
        self.best, self.tokens = [0], [0]
        self.terminal: dict[str, int] = {}

    def add(self, words: Iterable[str]) -> None:
        """Insert pre-tokens, sorted so that each continues from the prefix it shares with the one before."""
        children, best, tokens = self.children, self.best, self.tokens
        before, path = "", [0]
        for word in sorted(words):
            marked = MARK + word
            shared, most = 0, min(len(before), len(marked))
            while shared < most and before[shared] == marked[shared]:
                shared += 1
            del path[shared + 1 :]
            scores, counts = [best[n] for n in path], [tokens[n] for n in path]
            node = path[-1]
            for end in range(shared, len(marked)):
                key = ord(marked[end]) << 40 | node  # low bits differ, as the hash table needs
                node = children.get(key, -1)
                if node < 0:
                    score, count = self._forward(marked, end, scores, counts)
                    node = children[key] = len(best)
                    best.append(score)
                    tokens.append(count)
                path.append(node)
                scores.append(best[node])
                counts.append(tokens[node])
            self.terminal[word] = tokens[node]
            before = marked

    def _alone(self, word: str) -> int:
        """Tokens of one pre-token, without the trie."""
        marked, scores, counts = MARK + word, [0], [0]
        for end in range(len(marked)):
            score, count = self._forward(marked, end, scores, counts)
            scores.append(score)
            counts.append(count)
        return counts[-1]

    def _forward(self, marked: str, end: int, scores: list[int], counts: list[int]) -> tuple[int, int]:
        """Best score of ``marked[: end + 1]`` and its tokens, from those of all shorter prefixes."""
        at, k = self.endings.get(marked[end]), end
        if at is None or "" not in at:
            n = len(marked[end].encode("utf-8", "surrogatepass"))
            top, few = scores[end] + n * self.byte_score, counts[end] + n
        else:
            top, few = scores[end] + at[""], counts[end] + 1
        while at is not None and k:
            k -= 1
            at = at.get(marked[k])
            if at is None:
                break
            score = at.get("")
            if score is not None:
                score += scores[k]
                if score > top or score == top and counts[k] < few - 1:
                    top, few = score, counts[k] + 1
        return top, few

    def count(self, words: list[str]) -> int:
        """Tokens of a text's pre-tokens.  Long ones are scored for this text only: nothing of them is kept."""
        if max(map(len, words), default=0) < LONG:
            distinct = set(words)
        else:
            distinct = {w for w in words if len(w) < LONG}
        if len(self.best) > self.limit:
            self.clear()
        if new := [w for w in distinct if w not in self.terminal]:
            self.add(new)
        long: dict[str, int] = {}
        total = 0
        for w in words:
            n = self.terminal.get(w) if len(w) < LONG else long.get(w)
            if n is None:
                n = long[w] = self._alone(w)
            total += n
        return total


def token_counts(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pre-tokens and tokens of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lex)
        for batch in batches:
            pre, tok = [], []
            for value in batch.column(1):
                words = (value.as_py() or "").split()
                pre.append(len(words))
                tok.append(counter.count(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pre, pa.int64()), pa.array(tok, pa.int64())], names=[id_col, "n_pretokens", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df, [id_col, text_col], run, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")


def op1_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of every whole text of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents"), load())
