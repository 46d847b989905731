"""Token counts of a unigram tokenizer without its tokens: Viterbi that carries the best score and the piece count.

An Aho-Corasick automaton gives all vocabulary matches by their end. Ties follow the public unigram implementation:
of paths with equal score to a place, the one whose last piece starts first stays; a letter that is no piece costs the least score less 10
and becomes its bytes, or part of one unknown token where the vocabulary has no bytes.
"""

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter(dict):
    """segment: number of its pieces. A segment is a word with its leading space mark; up to `keep` are remembered."""

    def __init__(self, vocabulary: list[tuple[str, float]], keep: int = 400_000):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.keep = keep

    def __missing__(self, segment: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        n = self[segment] = self.pieces(segment)
        return n

    def pieces(self, segment: str) -> int:
        size = len(segment)
        best, count, open_ = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        done = 0  # places up to here have their best path
        single = top = first = None

        def close(end: int) -> None:
            nonlocal single, top, first
            if not single:
                score = best[end - 1] + self.unknown
                if top is None or score > top:
                    best[end], open_[end] = score, True
                    more = len(segment[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else not open_[end - 1]
                    count[end] = count[end - 1] + more
                    single = top = first = None
                    return
            best[end], count[end] = top, count[first] + 1
            single = top = first = None

        for last, (length, score) in self.automaton.iter(segment):
            end = last + 1
            while done < end - 1:
                done += 1
                close(done)
            start = end - length
            total = best[start] + score
            if top is None or total > top:  # longest match first: starts ascend
                top, first = total, start
            single = single or length == 1
        while done < size:
            done += 1
            close(done)
        return count[size]


def segments(text: str) -> list[str]:
    """Words with their leading mark: each space starts one, and the text has one at its start."""
    if not text:
        return []
    marked = text.replace(" ", SPACE)
    if not marked.startswith(SPACE):
        marked = SPACE + marked
    return [SPACE + x for x in marked[1:].split(SPACE)]


def _counting(vocabulary):
    def count(batches):
        counter = Counter(vocabulary.value)
        for batch in batches:
            tokens = [sum(map(counter.__getitem__, segments(t))) if (t := x.as_py()) else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), batch.column(2)], names=["doc_id", "n_tokens", "n_bytes"])

    return count


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_bytes for every row, without shuffle.

    vocabulary: as read_vocabulary() gives it; its size is fixed by the tokenizer and it is sent to each executor once.
    Null and empty texts have 0 tokens. Null ids, repeated rows and an empty table need no care. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_counting(sent), f"doc_id {kind}, n_tokens long, n_bytes long")
