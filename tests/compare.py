"""Rows of a DataFrame and of a SQL text, made comparable."""


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return str(value) if isinstance(value, (list, dict, bytes)) else value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)


def duck_rows(con, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    return names, sorted((tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in found.fetchall()), key=str)
