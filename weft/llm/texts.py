"""What several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are runs of anything but space and \t \n \v \f \r; bytes.split() parts at just these.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z on UTF-8 bytes; no byte of a longer character is below 0x80.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The bytes of each text, one at a time."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py()


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


#: Bytes of an Arrow batch that goes to Python: texts of any length then take bounded memory on both sides.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_BYTES or one row. The limit is lowered for the session, as plans are made when they run."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # workers live on, and what they keep adds up over stages

    return df.mapInArrow(released, schema)
