"""Rows of a Spark frame and of DuckDB's SQL in a common form."""


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def assert_same(frame, duck, sql):
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, cursor.fetchall())
