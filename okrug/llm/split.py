"""Oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from okrug.llm.tokens import PYTHON, token_count

#: Ranks of the boundary before a token, from the strongest.
SECTION, PARAGRAPH, SENTENCE, WORD, CHARACTER = 4, 3, 2, 1, 0
BLANK_LINE = re.compile(r"\n[^\S\n]*\n|\r[^\S\r\n]*\r")
HEADING = re.compile(r"(?:#{1,6}\s|\f)|[^\n.;:,!?|]{0,80}[^\W_](?=\s*?(?:\n[^\S\n]*\r?\n|\Z))")
SENTENCE_END = re.compile(r"[.!?…]+[»”’\"')\]]*\Z")
PIECE = "limit_id int, piece_no int, first_token int, last_token int, overlap int, char_start int, char_end int, boundary int, piece string"


def boundaries(text: str, spans: list[tuple[int, int]]) -> bytearray:
    """For each token the rank of the boundary before it."""
    ranks = bytearray(len(spans))
    for k in range(1, len(spans)):
        end, start = spans[k - 1][1], spans[k][0]
        if end == start:
            continue
        gap = text[end:start]
        if gap == " ":
            rank = WORD
        elif BLANK_LINE.search(gap):
            rank = SECTION if HEADING.match(text, start) else PARAGRAPH
        elif "\n" in gap or "\r" in gap:
            rank = SECTION if text[start] == "#" else SENTENCE
        else:
            rank = WORD
        if rank == WORD and not text[start].islower() and SENTENCE_END.match(text[spans[k - 1][0] : end]):
            rank = SENTENCE
        ranks[k] = rank
    return ranks


def leaves(ranks: bytearray, cap: int) -> Iterator[tuple[int, int]]:
    """Token ranges of at most `cap` tokens in order: each range too long is cut at its strongest boundaries, and the parts in turn."""
    todo = [(0, len(ranks), SECTION)]
    while todo:
        low, high, rank = todo.pop()
        if high - low <= cap:
            if high > low:
                yield low, high
            continue
        if rank == CHARACTER:
            cuts = list(range(low, high, cap))
        else:
            cuts = [low, *(k for k in range(low + 1, high) if ranks[k] == rank)]
        todo.extend((a, b, max(rank - 1, CHARACTER)) for a, b in reversed(list(zip(cuts, [*cuts[1:], high]))))


def pieces(ranks: bytearray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first token, end, overlap) of each piece: leaves are packed greedily; each piece but the first begins with the last `overlap` tokens before it."""
    out, start, end, room = [], 0, 0, limit
    for low, high in leaves(ranks, limit - overlap):
        if high - start > room:
            out.append((max(0, start - overlap) if out else 0, end, overlap if out else 0))
            start, room = low, limit - overlap
        end = high
    if end > start:
        out.append((start - overlap if out else 0, end, overlap if out else 0))
    return out


def split_documents(documents: DataFrame, limits: list[tuple[int, int, int]], doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, limit_id, piece_no, ...): the pieces of every text that has more tokens than a limit; `limits` are (limit_id, max_tokens, overlap_tokens).

    A piece has at most max_tokens tokens; it shares exactly overlap_tokens tokens with the piece before; where it ends is
    the strongest boundary that the recursion of section, paragraph, sentence, word and character gives. `boundary` is that
    boundary's rank (4 to 0; 5 at the text's end), `char_start` and `char_end` place the piece in the text, so that pieces
    without their overlaps, and the blanks between, give the text back. `with_text` false leaves `piece` null.

    Tokens are counted in the JVM; only oversized texts go to Python, one at a time, without a shuffle. Null, empty and
    fitting texts have no rows; repeated texts each have theirs; other columns are ignored.
    """
    for _, most, overlap in limits:
        if not 0 <= overlap < most:
            raise ValueError("an overlap must be less than its limit")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {PIECE}"
    if not limits:
        return documents.sparkSession.createDataFrame([], schema)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for doc, body in zip(batch["doc_id"], batch["text"]):
                spans = [m.span() for m in PYTHON.finditer(body)]
                ranks = boundaries(body, spans)
                rows = []
                for limit, most, overlap in limits:
                    if len(spans) <= most:
                        continue
                    for no, (a, b, shared) in enumerate(pieces(ranks, most, overlap), 1):
                        at, to = spans[a][0], spans[b - 1][1]
                        rows.append((doc, limit, no, a + 1, b, shared, at, to, ranks[b] if b < len(spans) else 5, body[at:to] if with_text else None))
                yield pd.DataFrame(rows, columns=columns)

    least = min(most for _, most, _ in limits)
    return docs.where(token_count(F.col("text")) > least).mapInPandas(cut, schema)
