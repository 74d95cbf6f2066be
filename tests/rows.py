"""Comparison of results."""


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "item"):
        return plain(value.item())
    return value if isinstance(value, (str, int, bool)) else str(value)


def same_rows(df, con, sql):
    got, expected = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted((tuple(plain(v) for v in r) for r in d[cols].itertuples(index=False)), key=repr)
    assert rows(got) == rows(expected)
