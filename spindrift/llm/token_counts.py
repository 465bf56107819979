"""Token counts: trie-shared dynamic programming over distinct pre-tokens.

Pre-tokens are the units of ``unigram.units``. The distinct ones of a slice of rows form a trie:
sorted, those that share a prefix stand together, so the trie's nodes of one depth are the runs of
equal prefixes. A node's forward score (the best segmentation of its prefix, ties to fewer tokens)
is worked out once from its ancestors' scores, all nodes of a depth in one step. Where a depth has
fewer than ``NARROW`` pre-tokens left, the rest of the trie is walked one branch after the other:
each keeps the scores of the prefix that it shares with the branch before it. Each pre-token's
terminal stores its count; terminals of up to ``KEPT_LENGTH`` characters are kept for later slices,
``max_characters`` of them in all. Counts depend on none of these bounds.

Defined cases: a null or empty text has 0 pre-tokens and 0 tokens; a text of any length is read
whole, alone in its slice; repeated rows give repeated results, an empty table gives an empty
result; only the named input columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unigram
from .common import map_slices


NARROW = 16
KEPT_LENGTH = 64


class TrieCounter:
    def __init__(self, model: dict, max_characters: int = 8_000_000, narrow: int = NARROW):
        self.lexicon, self.max_characters, self.narrow = unigram.Lexicon(model), max_characters, narrow
        self.ends = {name[n:] for name in self.lexicon.scores for n in range(len(name))}
        self.terminal: dict[str, int] = {}
        self.characters = 0

    def counts(self, wanted: list[str]) -> dict[str, int]:
        """Terminals of all ``wanted`` pre-tokens (and of others)."""
        if self.characters > self.max_characters:
            self.terminal, self.characters = {}, 0
        known = self.terminal
        distinct = set(wanted)
        new = sorted(x for x in distinct if x not in known)
        found = dict(zip(new, self._trie(new), strict=True))
        short = {x: n for x, n in found.items() if len(x) <= KEPT_LENGTH}
        known.update(short)
        self.characters += sum(map(len, short))
        if len(short) == len(found):
            return known
        return found | {x: known[x] for x in distinct if x not in found}

    def _trie(self, words: list[str]) -> list[int]:
        if not words:
            return []
        lex = self.lexicon
        characters, size = unigram.code_points("".join(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(length) - length
        terminal = np.zeros(len(words), np.int64)
        # node arrays by depth: score, tokens, parent's place in the depth above, character
        scores, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
        parents: list[np.ndarray] = [np.zeros(1, np.int64)]
        letters: list[np.ndarray] = [np.zeros(1, np.uint64)]
        row, above = np.arange(len(words)), np.zeros(len(words), np.int64)  # of words this deep: their node above
        for depth in range(1, int(length.max()) + 1):
            keep = length[row] >= depth
            row, above = row[keep], above[keep]
            if len(row) < self.narrow:
                chains = [self._chain(a, scores, tokens, parents) for a in above.tolist()]
                terminal[row] = self._walk([words[i] for i in row.tolist()], chains)
                break
            at = begin[row] + depth - 1
            letter = characters[at]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (letter[1:] != letter[:-1]) | (above[1:] != above[:-1])
            here = np.cumsum(fresh) - 1
            parents.append(above[fresh])
            letters.append(letter[fresh])
            n_bytes = size[at[fresh]]
            best = np.full(len(n_bytes), -np.inf)
            fewest = np.zeros(len(n_bytes), np.int64)
            node, h, weight = np.arange(len(n_bytes)), np.zeros(len(n_bytes), np.uint64), 1
            for back in range(1, min(depth, lex.longest) + 1):  # the last piece has ``back`` characters
                up = depth - back
                h = h + letters[up + 1][node] * np.uint64(weight)
                weight = weight * int(unigram._BASE) & 0xFFFFFFFFFFFFFFFF
                node = parents[up + 1][node]
                piece = lex.lp[lex.find(h)]
                step = np.ones(len(piece), np.int64)
                if back == 1:
                    bare = np.isneginf(piece)
                    piece, step = np.where(bare, n_bytes * lex.byte_lp, piece), np.where(bare, n_bytes, 1)
                score, n = scores[up][node] + piece, tokens[up][node] + step
                better = (score > best) | (score == best) & (n < fewest)
                best, fewest = np.where(better, score, best), np.where(better, n, fewest)
            scores.append(best)
            tokens.append(fewest)
            above = here
            ended = length[row] == depth
            terminal[row[ended]] = fewest[here[ended]]
        return terminal.tolist()

    @staticmethod
    def _chain(node: int, scores: list, tokens: list, parents: list) -> tuple[list[float], list[int]]:
        """Scores and tokens of a node's prefixes, the root's first."""
        out: tuple[list[float], list[int]] = [], []
        for depth in range(len(scores) - 1, -1, -1):
            out[0].append(float(scores[depth][node]))
            out[1].append(int(tokens[depth][node]))
            node = int(parents[depth][node])
        return out[0][::-1], out[1][::-1]

    def _walk(self, words: list[str], chains: list[tuple[list[float], list[int]]]) -> list[int]:
        """Terminals of sorted ``words``, branch by branch; ``chains``: what is known of each."""
        lex, ends = self.lexicon, self.ends
        out: list[int] = []
        last, scores, tokens = "", [0.0], [0]
        for word, (known_scores, known_tokens) in zip(words, chains, strict=True):
            text = word.replace(unigram.SPACE, "\uffff").replace(" ", unigram.SPACE)
            same = _shared(last, text)
            if same < len(known_scores) - 1:
                scores, tokens = known_scores, known_tokens
            else:
                del scores[same + 1 :], tokens[same + 1 :]
            for end in range(len(scores), len(text) + 1):
                best, fewest = -np.inf, 0
                for start in range(end - 1, max(0, end - lex.longest) - 1, -1):
                    part = text[start:end]
                    piece = lex.scores.get(part)
                    if piece is not None:
                        n, score = 1, scores[start] + piece[1]
                    elif start == end - 1:
                        n = len(word[start].encode())
                        score = scores[start] + n * lex.byte_lp
                    elif part in ends:
                        continue
                    else:
                        break
                    if score > best or score == best and tokens[start] + n < fewest:
                        best, fewest = score, tokens[start] + n
                    if part not in ends:
                        break
                scores.append(best)
                tokens.append(fewest)
            last = text
            out.append(tokens[-1])
        return out


def _shared(a: str, b: str) -> int:
    """Characters of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = unigram.MODEL, max_characters: int = 8_000_000) -> DataFrame:
    """One row a text: ``n_pretokens`` and ``n_tokens`` (long). Map only, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(unigram.load(model))

    def make():
        counter = TrieCounter(shared.value, max_characters)

        def step(batch: pa.RecordBatch) -> dict:
            parts = [unigram.units(t) if t else [] for t in batch.column(1).to_pylist()]
            found = counter.counts([u for p in parts for u in p]).__getitem__
            tokens = [sum(map(found, p)) for p in parts]
            return {"id": batch.column(0), "n_pretokens": pa.array(map(len, parts), pa.int64()), "n_tokens": pa.array(tokens, pa.int64())}

        return step

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(picked, "text", make, f"id {kind}, n_pretokens bigint, n_tokens bigint").withColumnRenamed("id", id_col)
