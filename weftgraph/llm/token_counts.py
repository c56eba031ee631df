"""Token counts by heap-and-linked-list byte-pair merging (operator 1)."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import tokenizer_path

#: Texts over so many tokens are marked.
LIMIT = 4096
#: Distinct words whose counts a worker keeps; at that many it starts afresh. Longer ones than KEPT_LENGTH characters are
#: counted each time, so its memory is bounded.
KEPT_WORDS, KEPT_LENGTH = 600_000, 64
_SPACE = "▁"


class WordCounts(dict):
    """Tokens of each word met, counted on first sight.

    ranks: rank of each piece, low first; a piece's place in the model's order of scores. single: symbols that are pieces
    by themselves; any other character stands for as many symbols as it has UTF-8 bytes once no merge has taken it.
    """

    def __init__(self, ranks: dict[str, int], single: set[str]):
        super().__init__()
        self.ranks, self.single = ranks, single

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n

    def count(self, word: str) -> int:
        """Initial symbols less merges: pop the lowest-ranked adjacent pair (leftmost on ties), join it, look at its new neighbours."""
        ranks, symbols = self.ranks, list(word)
        n = len(symbols)
        heap = [(r, i, s) for i in range(n - 1) if (r := ranks.get(s := symbols[i] + symbols[i + 1])) is not None]
        left = n
        if heap:
            heapq.heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                _, i, joined = heapq.heappop(heap)
                a = symbols[i]
                if a is None:
                    continue
                j = after[i]
                if j >= n or len(a) + len(symbols[j]) != len(joined) or a + symbols[j] != joined:
                    continue
                symbols[i], symbols[j] = joined, None
                left -= 1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    s = joined + symbols[k]
                    if (r := ranks.get(s)) is not None:
                        heapq.heappush(heap, (r, i, s))
                k = before[i]
                if k >= 0:
                    s = symbols[k] + joined
                    if (r := ranks.get(s)) is not None:
                        heapq.heappush(heap, (r, k, s))
        if not self.single.issuperset(word):
            left += sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in self.single)
        return left


@lru_cache(maxsize=2)
def word_counts(path: str) -> tuple[WordCounts, re.Pattern]:
    """The counter for a sentencepiece BPE model with byte fallback, and the pattern of the units that no piece crosses."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    pieces = {model.id_to_piece(i): model.get_score(i) for i in plain}
    order = sorted(set(pieces.values()), reverse=True)
    place = {s: k for k, s in enumerate(order)}
    ranks = {p: place[s] for p, s in pieces.items() if len(p) > 1}
    if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
        raise ValueError("a piece has a space after other characters, so texts can't be cut at spaces")
    cuts = "" if any("\n" in p for p in pieces) else "\n"
    unit = re.compile(f"{_SPACE}+[^{_SPACE}{cuts}]*" + (f"|\n|[^{_SPACE}\n]+" if cuts else ""))
    return WordCounts(ranks, {p for p in pieces if len(p) == 1}), unit


def tokens_in(text: str, counter: WordCounts, unit: re.Pattern) -> int:
    """Tokens of a text: a space goes before it, and spaces are the model's space symbol."""
    return sum(map(counter.__getitem__, unit.findall(_SPACE + text.replace(" ", _SPACE)))) if text else 0


def count_tokens(df: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    One row for each input row: a null id stays null, a null or empty text has 0 of both, repeated rows are counted each.
    An empty table gives none. Other columns are left out, so their names don't matter. No shuffle: a row's count needs
    only its text, however long it is. A worker keeps the counts of at most KEPT_WORDS distinct words of at most
    KEPT_LENGTH characters; Spark bounds the bytes of an Arrow batch (spark.sql.execution.arrow.maxBytesPerBatch).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, unit = word_counts(tokenizer_path(model))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(tokens_in(text, counter, unit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    found = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
