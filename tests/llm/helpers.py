"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(items, linked):
    """Smallest reachable item of each item."""
    parent = {i: i for i in items}
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in items}


DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank string"


def documents(spark, rows):
    """Documents with two more columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


def rows_by_sql(sql, folder, columns):
    """Rows of DuckDB SQL over the Parquet tables of a folder, sorted, in the order of the given columns."""
    import duckdb

    con = duckdb.connect()
    for path in sorted(folder.iterdir()):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    order = [names.index(c) for c in columns]
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
