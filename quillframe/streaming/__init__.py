"""The engine's operator set is batch only, so there is nothing here beyond this note: a
``LazyFrame`` can wrap a streaming DataFrame, and the stateless operators (select, filter,
with_column) then pass through to Structured Streaming unchanged."""
