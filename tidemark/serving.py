"""Queries over the network: an Arrow Flight server that takes a query as ticket, and its client.

The server streams a result one partition at a time. Which output the query asks for is sent along, and the client
carries it out on its own side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from typing import TextIO

import pyarrow as pa
from pyarrow import flight
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.engine import Engine
from tidemark.plans.analyze import Output, SeriesQuery
from tidemark.plans.output import arrow_batches, emit

PORT = 51033


def _batches(df: DataFrame, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in arrow_batches(df):
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)


class QueryServer(flight.FlightServerBase):
    """DoGet only; the other verbs of the protocol aren't offered."""

    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = PORT) -> None:
        super().__init__(f"grpc://{host}:{port}")
        self.engine = engine

    def do_get(self, context: flight.ServerCallContext, ticket: flight.Ticket) -> flight.FlightDataStream:
        try:
            text = ticket.ticket.decode()
            query = self.engine.analyze(text)
            df = self.engine.query(text)
        except (ValueError, LookupError) as e:
            raise flight.FlightServerError(str(e)) from None
        output = json.dumps(asdict(query.output)).encode()
        schema = to_arrow_schema(df.schema)
        if isinstance(query, SeriesQuery) and not query.format_datetime:
            schema = schema.set(0, pa.field(schema.field(0).name, pa.timestamp("ns", "UTC")))  # Arrow has what Spark lacks
        schema = schema.with_metadata({b"output": output})
        return flight.GeneratorStream(schema, _batches(df, schema))


class QueryClient:
    """Sends queries to a server; results come back as Arrow tables."""

    def __init__(self, host: str = "127.0.0.1", port: int = PORT) -> None:
        self._client = flight.connect(f"grpc://{host}:{port}")

    def query(self, text: str) -> pa.Table:
        return self._client.do_get(flight.Ticket(text.encode())).read_all()

    def run(self, text: str, spark: SparkSession, stream: TextIO | None = None) -> DataFrame | None:
        """Query and send the result where the query's options say, on this side."""
        table = self.query(text)
        output = Output(**json.loads((table.schema.metadata or {})[b"output"]))
        return emit(spark.createDataFrame(table), output, stream)

    def close(self) -> None:
        self._client.close()
