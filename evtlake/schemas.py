"""Schemas and small declarative types shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field

RAW_EVENT = "block_number bigint, block_hash string, transaction_hash string, contract_address string, keys array<string>, data array<string>, finality_status string, event_seq bigint"
BLOCKS = "block_number bigint, timestamp bigint"
CURSORS = "contract_name string, last_block bigint"
REORGS = "start_block bigint, end_block bigint, seq bigint"
ABI_MEMBER = "abi_name string, kind string, name string, full_name string, selector string, part string, pos int, member string, type_name string"
CALL_RESULT = "contract_address string, function string, block_number bigint, ts bigint, result array<string>"

# Fixed values of the data model.
DEFAULT_STATUS = "ACCEPTED_ON_L2"
DEFAULT_LIMIT, LIMIT_CAP = 50, 500
CATCHUP_BLOCKS, CONFIRMATION_DEPTH = 50, 10
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte")
#: Blocks of one partition folder of a stored log.
BUCKET_BLOCKS = 10_000


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}; one of {', '.join(OPERATORS)}")


@dataclass(frozen=True)
class Query:
    """Filters are all required; rows come by `order`, then log_index in the same direction."""

    filters: tuple[Filter, ...] = ()
    order: str = "block_number"
    descending: bool = True
    limit: int | None = DEFAULT_LIMIT
    offset: int = 0

    def __post_init__(self) -> None:
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be at least 1")
        if self.offset < 0:
            raise ValueError("offset must not be negative")


@dataclass(frozen=True)
class Aggregate:
    """operation: sum, count or avg of a field, under a column name."""

    column: str
    operation: str
    field: str = ""

    def __post_init__(self) -> None:
        if self.operation not in ("sum", "count", "avg"):
            raise ValueError(f"unknown aggregate {self.operation!r}")


@dataclass(frozen=True)
class TableSpec:
    name: str
    kind: str = "log"
    unique_key: str = ""
    aggregates: tuple[Aggregate, ...] = field(default_factory=tuple)
    shared: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("log", "unique", "aggregation"):
            raise ValueError(f"unknown table kind {self.kind!r}")
        if self.kind == "unique" and not self.unique_key:
            raise ValueError("a unique table needs a unique_key")
