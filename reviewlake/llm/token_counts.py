"""Token counts: a unigram model's best split, scored once for each prefix that pre-tokens share.

A task inserts its distinct pre-tokens in a trie. Each node holds the best forward score of its prefix and the tokens
that it takes, computed from the nodes above it; a pre-token's count is stored at its last node, and a document's
count is the sum over its pre-tokens. The trie is a task's cache and is begun anew beyond MAX_NODES nodes, which
bounds memory and changes no result. Nothing is shuffled.

The pieces come from a public vocabulary, in its order of rank; tokenizers are never trained here, so a piece's log
probability is not estimated but follows Zipf's law on its rank. The counts are those of this model, which the query names
in a column, and not those of the tokenizer that the vocabulary comes from. A character that
no piece covers costs UNKNOWN and counts as its UTF-8 bytes. Equal scores: the fewer tokens win.

Cases: a null or empty text has 0 pre-tokens and 0 tokens; repeated rows give repeated results; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from reviewlake.llm.common import WORD, id_and_text

MARK = "▁"
UNKNOWN = -30.0
MAX_NODES = 800_000


def load_pieces(path: str) -> dict[str, float]:
    """Piece to log probability; control, byte and unused pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or model.get_score(i) <= -1e8)]
    return {model.id_to_piece(i): -math.log(rank + 1.0) for rank, i in enumerate(ids, 1)}


class PrefixTrie:
    """Forward scores of the prefixes of what was inserted."""

    def __init__(self, pieces: dict[str, float]):
        # Pieces by their characters from the last to the first, so that a search ends where no piece has that ending.
        self.endings: dict = {}
        for piece, p in pieces.items():
            below = self.endings
            for c in reversed(piece):
                below = below.setdefault(c, {})
            below[""] = p
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]
        self.counts: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a pre-token, whose text is MARK and the word."""
        known = self.counts.get(word)
        if known is not None:
            return known
        if len(self.score) > MAX_NODES:
            self.clear()
        text, node, path = MARK + word, 0, [0]
        child, score, tokens, endings = self.child, self.score, self.tokens, self.endings
        for end, c in enumerate(text):
            key = node << 21 | ord(c)
            below = child.get(key)
            if below is None:
                best, used = score[node] + UNKNOWN, tokens[node] + len(c.encode("utf-8", "surrogatepass"))
                start, ending = end, endings.get(c)
                while ending is not None:
                    p = ending.get("")
                    if p is not None:
                        above = path[start]
                        s, n = score[above] + p, tokens[above] + 1
                        if s > best or s == best and n < used:
                            best, used = s, n
                    if not start:
                        break
                    start -= 1
                    ending = ending.get(text[start])
                below = child[key] = len(score)
                score.append(best)
                tokens.append(used)
            node = below
            path.append(node)
        self.counts[word] = tokens[node]
        return tokens[node]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_distinct, n_tokens of every whole text. vocabulary: path of a sentencepiece model."""

    def count(batches):
        trie, find = PrefixTrie(load_pieces(vocabulary)), re.compile(WORD).findall
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = Counter(find(text or ""))
                rows.append((sum(words.values()), len(words), sum(n * trie.count(w) for w, n in words.items())))
            yield pa.record_batch([b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=["doc_id", "n_pretokens", "n_distinct", "n_tokens"])

    return id_and_text(docs).mapInArrow(count, "doc_id long, n_pretokens long, n_distinct long, n_tokens long")
