"""Messages in columns: building, reading, field iteration, filtering, extraction, handlers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.functions import varint as V
from chunkwell.functions.errors import MessageError
from chunkwell.functions.messages import Spec, copy_fields, decode_events, encode_columns, fields_of, is_message, parse, slices_of, top_level

#: A field event in a column; of the values only the one of the wire type is set.
FIELD = "struct<field_number:int,wire_type:int,varint:bigint,fixed32:bigint,fixed64:bigint,bytes:binary,depth:int>"


def encode_message(specs: Iterable[Spec], *columns: Column | str) -> Column:
    """A message of ``columns`` by ``specs`` (one each, in this order); nulls are left out."""
    specs = tuple(specs)
    given = [F.col(c) if isinstance(c, str) else c for c in columns] or [F.col(s.name) for s in specs]

    @F.arrow_udf("binary")
    def run(*values: pa.Array) -> pa.Array:
        return encode_columns(list(values), specs, len(values[0]))

    # casts make the Arrow types those that the specs promise
    return run(*[c.cast(s.ddl) for c, s in zip(given, specs, strict=True)])


def decode_message(record: Column, specs: Iterable[Spec]) -> Column:
    """A struct of the fields that ``specs`` name; absent ones, and those of a record that is no message, are null."""
    specs = tuple(specs)

    @F.arrow_udf("struct<" + ",".join(f"{s.name}:{s.ddl}" for s in specs) + ">")
    def run(v: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(decode_events(parse(v), specs, len(v)), fields=[pa.field(s.name, s.arrow) for s in specs])

    return run(record)


def is_proto(record: Column) -> Column:
    """Whether a record is a well-formed, canonical message."""

    @F.arrow_udf("boolean")
    def run(v: pa.Array) -> pa.Array:
        return pa.array(parse(v).ok, mask=np.asarray(v.is_null()))

    return run(record)


def is_parseable(record: Column) -> Column:
    """As :func:`is_proto`, but overlong varints pass."""

    @F.arrow_udf("boolean")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if r is None else is_message(r, canonical=False) for r in v.to_pylist()], pa.bool_())

    return run(record)


def parse_fields(record: Column) -> Column:
    """The field events of a record in order, groups flat with their depth; null if it is no message."""

    @F.arrow_udf(f"array<{FIELD}>")
    def run(v: pa.Array) -> pa.Array:
        e = parse(v)
        place = lambda wire: pa.array(e.wire != wire)
        number = lambda wire: pa.array(e.value.view(np.int64), mask=np.asarray(place(wire)))
        offsets, data = slices_of(e.data, e.start, np.where(e.wire == V.BYTES, e.size, 0))
        from chunkwell.sources.simple import binary_array

        blob = binary_array(offsets, data)
        blob = blob.take(pa.array(np.arange(len(blob)), mask=np.asarray(place(V.BYTES))))
        events = pa.StructArray.from_arrays(
            [pa.array(e.number.astype(np.int32)), pa.array(e.wire.astype(np.int32)), number(V.VARINT), number(V.FIXED32), number(V.FIXED64), blob, pa.array(e.depth)],
            names=["field_number", "wire_type", "varint", "fixed32", "fixed64", "bytes", "depth"],
        )
        counts = np.bincount(e.record, minlength=len(v))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), events, mask=pa.array(~e.ok))

    return run(record)


def explode_fields(records: DataFrame, record: str = "record", keep: Iterable[str] = ()) -> DataFrame:
    """One row per field event: ``keep``, ``field_index`` and the event's parts."""
    rows = records.select(*keep, F.posexplode(parse_fields(F.col(record))).alias("field_index", "field"))
    return rows.select(*keep, "field_index", "field.*")


def copy_message_fields(record: Column, numbers: Iterable[int], path: Column | None = None, pos: Column | None = None) -> Column:
    """The top-level fields with ``numbers``, groups whole; a record that is no message passes unchanged.

    A record that parses but is not canonical is an error.  With the ``_path`` and ``pos`` columns of a scan it
    names the record's file and position, which are the same whatever the splits; else its place in the batch.
    """
    from chunkwell.operators.projection import Field, Projection

    wanted = frozenset(numbers)
    top = Projection(*[Field((n,)) for n in sorted(wanted)])

    @F.arrow_udf("binary")
    def run(v: pa.Array, *where: pa.Array) -> pa.Array:
        bad = np.flatnonzero(~parse(v).ok)
        for i in bad.tolist():
            r = v[i].as_py()
            if r is not None and is_message(r, canonical=False):
                if where:
                    raise MessageError(f"a message that is not canonical at {where[0][i].as_py()}:{where[1][i].as_py()}")
                raise MessageError("a message that is not canonical", i)
        return top.apply_array(v)

    return run(record) if path is None or pos is None else run(record, path, pos)


def extract_varints(records: DataFrame, number: int, record: str = "record", keep: Iterable[str] = ()) -> DataFrame:
    """All top-level varint values of a field (``value``), one row each; groups and other wire types are passed over."""

    @F.arrow_udf("array<bigint>")
    def run(v: pa.Array) -> pa.Array:
        e = parse(v)
        at = (e.number == number) & (e.wire == V.VARINT) & (e.depth == 0)
        counts = np.bincount(e.record[at], minlength=len(v))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(e.value[at].view(np.int64)))

    return records.select(*keep, F.explode(run(F.col(record))).alias("value"))


# Handlers.


class FieldHandler:
    """Callbacks for one field number; return or raise to go on or to stop."""

    number = 0

    def on_varint(self, value: int): ...
    def on_fixed32(self, value: int): ...
    def on_fixed64(self, value: int): ...
    def on_length_delimited(self, value: bytes): ...
    def on_start_group(self): ...
    def on_end_group(self): ...


_CALLS = {V.VARINT: "on_varint", V.FIXED32: "on_fixed32", V.FIXED64: "on_fixed64", V.BYTES: "on_length_delimited", V.START_GROUP: "on_start_group", V.END_GROUP: "on_end_group"}


class HandlerSet:
    """Handlers by number; the first with a field's number gets it.  An empty set only validates."""

    def __init__(self, *handlers: FieldHandler):
        self.handlers = list(handlers)

    def call_of(self, number: int, wire: int) -> Callable | None:
        return next((getattr(h, _CALLS[wire]) for h in self.handlers if h.number == number), None)

    def dispatch(self, f) -> bool:
        return _call(self.call_of(f.number, f.wire), f)


class DynamicHandlers:
    """Callables by (number, wire type); registering again replaces."""

    def __init__(self):
        self.calls: dict[tuple[int, int], Callable] = {}

    def on(self, number: int, wire: int, call: Callable) -> DynamicHandlers:
        self.calls[number, wire] = call
        return self

    def call_of(self, number: int, wire: int) -> Callable | None:
        return self.calls.get((number, wire))

    def dispatch(self, f) -> bool:
        return _call(self.call_of(f.number, f.wire), f)


def _call(call: Callable | None, f) -> bool:
    if call is None:
        return False
    call(f.value) if f.value is not None else call()
    return True


def read_message(data: bytes, handlers) -> None:
    """Dispatch every field event of a message in order, those inside groups too."""
    for f in fields_of(data):
        handlers.dispatch(f)


def fold_records(records: DataFrame, make: Callable, schema: str, record: str = "record") -> DataFrame:
    """Partial results of a handler fold, one row per task; aggregate them with Spark.

    ``make()`` returns (handlers, fallback, result): messages go to ``handlers``, other records to
    ``fallback(index, bytes)``, and ``result()`` gives the row of the task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        handlers, fallback, result = make()
        index = 0
        for batch in batches:
            v = batch.column(0)
            e = parse(v)
            # only fields that a handler wants leave NumPy
            kinds = e.number << 3 | e.wire
            wanted = {k: call for k in np.unique(kinds).tolist() if (call := handlers.call_of(k >> 3, k & 7)) is not None}
            at = np.flatnonzero(np.isin(kinds, list(wanted)))
            cuts = [*np.flatnonzero(~e.ok).tolist(), len(v)]
            ends = np.searchsorted(e.record[at], cuts).tolist()
            begin = 0
            for r, end in zip(cuts, ends, strict=True):
                part = at[begin:end]
                for k, value, row, start, size in zip(kinds[part].tolist(), e.value[part].tolist(), e.record[part].tolist(), e.start[part].tolist(), e.size[part].tolist(), strict=True):
                    try:
                        if k & 7 in (V.START_GROUP, V.END_GROUP):
                            wanted[k]()
                        else:
                            wanted[k](e.data[start : start + size].tobytes() if k & 7 == V.BYTES else value)
                    except MessageError as error:
                        raise MessageError(str(error), index + row) from error
                if r < len(v):
                    fallback(index + r, v[r].as_py())
                begin = end
            index += len(v)
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(result(), arrow, strict=True)], schema=arrow)

    return records.select(record).mapInArrow(run, schema)


__all__ = ["DynamicHandlers", "FieldHandler", "HandlerSet", "Spec", "copy_fields", "copy_message_fields", "decode_message", "encode_message", "explode_fields", "extract_varints", "fold_records", "is_parseable", "is_proto", "parse_fields", "read_message", "top_level"]
