"""DataFrame operators: `fn(df, ...) -> df`, to be chained with `df.transform`."""
