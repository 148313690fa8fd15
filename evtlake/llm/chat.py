"""Chat formatting: whole conversations rendered by a reversible template, encoded once with offsets, masked by turns.

A turn is rendered as `<turn>role<says>text</turn>`. The three marks are tokens of their own in the encoder, so no token
crosses the border of a text. A mark, or a special string of the vocabulary, that stands inside a role or a text gets a
backslash after its first character, and each backslash is doubled; `unescaped` takes both back. The loss mask marks the
tokens that overlap the span of a text to learn: token spans and turn spans are both sorted, so each token finds its turn by
binary search.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any size spreads over tasks. One that crosses a
range, or has more than `PART_CHARS` characters, comes as several parts, cut between turns; as marks end every turn, the
parts' tokens are those of the whole. `digests` reads the parts back in order, one at a time.

Defined results: rows go by turn (null first), ties by role, then by the text's SHA-256; repeated rows are repeated turns;
a null role or text is empty; null conv_ids are one conversation; a text of any length is one turn and travels alone; an
empty table has no conversations; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import bounded, lean
from .tokens import vocabulary_path

# The marks of the template.
OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
MARKS = [OPEN, SAYS, CLOSE]
#: Characters of a part, but for one turn that has more.
PART_CHARS = 1 << 20
#: Characters encoded at once.
BATCH_CHARS = 1 << 20
PARTS = "place bigint, n_turns bigint, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"
DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The vocabulary's tokenizer with the marks added, and the pattern of what must not stand inside a text."""
    from tokenizers import AddedToken, Tokenizer

    whole = Tokenizer.from_file(vocabulary_path(vocabulary))
    own = [t.content for t in whole.get_added_tokens_decoder().values()]
    whole.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
    return whole, control_pattern([*MARKS, *own])


def control_pattern(strings: list[str]) -> re.Pattern:
    """A backslash, or the first character of a control string."""
    if any("\\" in s for s in strings):
        raise ValueError("control strings must not hold a backslash")
    return re.compile("|".join([r"\\", *(f"{re.escape(s[0])}(?={re.escape(s[1:])})" for s in strings)]))


def escaped(text: str, control: re.Pattern) -> str:
    return control.sub(lambda m: m[0] + "\\", text)


_BACK = re.compile(r"\\(\\?)")


def unescaped(text: str) -> str:
    """Of two backslashes one stays; a single one, which breaks a control string, goes."""
    return _BACK.sub(r"\1", text)


def rendered(turns: list[tuple[str, str]], control: re.Pattern) -> tuple[str, np.ndarray]:
    """The text of turns and the span of each turn's text in it."""
    pieces, spans, at = [], np.zeros((len(turns), 2), np.int64), 0
    for i, (role, text) in enumerate(turns):
        head = f"{OPEN}{escaped(role, control)}{SAYS}"
        body = escaped(text, control)
        spans[i] = at + len(head), at + len(head) + len(body)
        pieces += head, body, CLOSE
        at += len(head) + len(body) + len(CLOSE)
    return "".join(pieces), spans


def token_mask(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Tokens (start, end) that overlap one of the spans; both sorted, spans apart from each other."""
    if not len(spans):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(spans[:, 1], tokens[:, 0], "right")  # the first span that ends after the token's start
    return (at < len(spans)) & (tokens[:, 1] > spans[np.minimum(at, len(spans) - 1), 0]) & (tokens[:, 1] > tokens[:, 0])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a rendered text."""
    turns = []
    for piece in formatted.split(CLOSE)[:-1]:
        role, _, text = piece[len(OPEN) :].partition(SAYS)
        turns.append((unescaped(role), unescaped(text)))
    return turns


def masked_texts(formatted: str, tokens: np.ndarray, loss: np.ndarray) -> Iterator[str]:
    """The stretches of text under the mask, unescaped; tokens that share a character count once."""
    kept = tokens[loss]
    if not len(kept):
        return
    reach = np.maximum.accumulate(kept[:, 1])
    cuts = np.flatnonzero(kept[1:, 0] > reach[:-1]) + 1
    for first, last in zip(np.r_[0, cuts], np.r_[cuts, len(kept)] - 1):
        yield unescaped(formatted[kept[first, 0] : reach[last]])


def formatted(conversations: DataFrame, learn: tuple[str, ...] = ("assistant",), vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Parts of conversations: conv_id, place (ascending inside a conversation), n_turns, formatted, token_ids, token_starts
    and token_ends (code points), loss (tokens of texts whose role is in `learn`)."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("tie"), F.monotonically_increasing_id().alias("uid"))
    order = ["conv_id", "turn", "role", "tie", "uid"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    key = conversations.schema["conv_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list]]:
        current, turns, size = None, [], 0
        for batch in batches:
            for conv_id, role, said in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and (conv_id != current or size > PART_CHARS):
                    yield current, turns
                    turns, size = [], 0
                current = conv_id
                turns.append((role, said))
                size += len(said)
        if turns:
            yield current, turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, control = encoder(vocabulary)
        place, held, chars = TaskContext.get().partitionId() << 40, [], 0
        for conv_id, turns in parts(batches):
            held.append((conv_id, turns, *rendered(turns, control)))
            chars += len(held[-1][2])
            if chars > BATCH_CHARS:
                yield encoded(held, whole, place)
                place, held, chars = place + len(held), [], 0
        if held:
            yield encoded(held, whole, place)

    def encoded(held: list, whole, place: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(8)]
        for i, (found, (conv_id, turns, shown, spans)) in enumerate(zip(whole.encode_batch([h[2] for h in held], add_special_tokens=False), held)):
            tokens = np.array(found.offsets, np.int32).reshape(-1, 2)
            mask = token_mask(tokens, spans[[role in learn for role, _ in turns]])
            for column, value in zip(columns, (conv_id, place + i, len(turns), shown, found.ids, tokens[:, 0], tokens[:, 1], mask)):
                column.append(value)
        kinds = [kind, pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
        names = ["conv_id", "place", "n_turns", "formatted", "token_ids", "token_starts", "token_ends", "loss"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = to_arrow_type(conversations.schema["conv_id"].dataType)
    return bounded(rows).mapInArrow(lean(run), f"conv_id {key}, {PARTS}")


def digests(parts: DataFrame) -> DataFrame:
    """What the parts hold, read back: turns from the formatted text, learned text from the tokens under the mask."""
    key = parts.schema["conv_id"].dataType.simpleString()
    order = parts.select("conv_id", "place", "formatted", "token_starts", "token_ends", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, state = [], None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, conv_id in enumerate(ids):
                if state is None or conv_id != current:
                    if state:
                        out.append((current, *state.row()))
                    current, state = conv_id, _Digest()
                shown, starts, ends, loss = (batch.column(c)[i] for c in (2, 3, 4, 5))
                spans = np.column_stack([starts.values.to_numpy(), ends.values.to_numpy()])
                state.add(shown.as_py(), spans, loss.values.to_numpy(zero_copy_only=False).astype(bool))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if state:
            out.append((current, *state.row()))
        if out:
            yield batch_of(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    kind = to_arrow_type(parts.schema["conv_id"].dataType)
    return bounded(order).mapInArrow(lean(run), f"conv_id {key}, {DIGESTS}")


class _Digest:
    """Counts and running hashes of one conversation."""

    def __init__(self) -> None:
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.n_learned = self.chars = 0

    def add(self, formatted: str, tokens: np.ndarray, loss: np.ndarray) -> None:
        for role, text in read_turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for text in masked_texts(formatted, tokens, loss):
            self.learned.update(text.encode())
            self.n_learned += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.n_learned, self.learned.hexdigest(), self.chars
