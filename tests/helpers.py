"""Small helpers that the tests share."""

import datetime as dt


def d(text):
    return None if text is None else dt.date.fromisoformat(text)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def as_dict(df, key):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}
