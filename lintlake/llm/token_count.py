"""Token counts of a unigram tokenizer without making tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character;
dynamic programming keeps, for each end, the best score and the number of pieces on its path.

Rules of the tokenizer: spaces become U+2581, one is put in front unless there is one, and each
starts a new stretch; no piece spans two stretches. A path's score is the sum of its pieces' scores. Of equal
scores at an end the one whose last piece starts first wins. A character that no single piece
matches may be unknown, at the least score less 10; unknown characters in a row are one token, or,
with byte pieces, as many as they have UTF-8 bytes.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm._store import table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 200_000  # stretches whose result a task remembers
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k)
    return [(model.id_to_piece(k), float(model.get_score(k)))
            for k in range(model.get_piece_size()) if not skip(k)]


class Counter:
    """Counts of single stretches."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_pieces: bool = True) -> None:
        self.machine = ahocorasick.Automaton()
        self.known = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        for piece, score in vocabulary:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()

    def count(self, stretch: str) -> tuple[int, float]:
        """(tokens, best score)."""
        n = len(stretch)
        best: list[float | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)
        best[0] = 0.0
        single = [c in self.known for c in stretch]
        matches = self.machine.iter(stretch)
        match = next(matches, None)
        for end in range(n):
            at = end + 1
            top, of, last = None, 0, False
            # Matches of one end come longest first, so a tie keeps the earlier start.
            while match is not None and match[0] == end:
                size, score = match[1]
                start = at - size
                if best[start] is not None and (top is None or best[start] + score > top):
                    top, of = best[start] + score, pieces[start] + 1
                match = next(matches, None)
            if not single[end] and best[end] is not None:
                score = best[end] + self.unknown
                if top is None or score > top:
                    top, last = score, True
                    if self.byte_pieces:
                        of = pieces[end] + len(stretch[end].encode("utf-8", "surrogatepass"))
                    else:
                        of = pieces[end] + (not unknown[end])
            best[at], pieces[at], unknown[at] = top, of, last
        return pieces[n], best[n]


def stretches(text: str) -> list[str]:
    """What the tokenizer cuts a text into."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    return [SPACE + p for p in (parts[1:] if text[0] in (" ", SPACE) else parts)]


def _count(vocabulary: list[tuple[str, float]], byte_pieces: bool):
    def run(batches):
        counter = Counter(vocabulary, byte_pieces)
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            tokens, scores = [], []
            for text in batch.column(1).to_pylist():
                n, total = 0, 0.0
                for part in stretches(text or ""):
                    found = known.get(part)
                    if found is None:
                        found = counter.count(part)
                        if len(known) >= CACHE:
                            known.clear()
                        if len(part) <= 64:
                            known[part] = found
                    n += found[0]
                    total += found[1]
                tokens.append(n)
                scores.append(total)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "n_tokens": pa.array(tokens, pa.int64()),
                "score": pa.array(scores, pa.float64()),
            })

    return run


def count_tokens(
    docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id",
    text_col: str = "text", byte_pieces: bool = True,
) -> DataFrame:
    """(id, n_tokens, score) for every row; score is that of the best segmentation.

    A null or empty text has no tokens and score 0. Rows without id keep a null id; repeated rows
    are counted each; other columns are ignored. The vocabulary travels to every task: a tokenizer
    has some ten or hundred thousand pieces, whatever the size of the corpus.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(
        _count(vocabulary, byte_pieces), "id long, n_tokens long, score double"
    ).withColumnRenamed("id", id_col)


def op6_token_count(
    spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY
) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary(vocabulary))
