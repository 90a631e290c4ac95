from vicinity.schema import CHUNKS, NOTES


def rows(df, *order):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def notes_of(spark, *items):
    """Notes from ``(path, content)`` or ``(path, content, mtime)``."""
    data = [
        (i[0], i[0].rsplit("/", 1)[-1].removesuffix(".md"), i[1], i[2] if len(i) > 2 else 1)
        for i in items
    ]
    return spark.createDataFrame(data, NOTES)


def chunks_of(spark, *items):
    """Chunks from ``(path, chunk_index, vector)``."""
    data = [
        (p, f"title {p}", f"{p}#{i}", i, 1, None if v is None else [float(x) for x in v])
        for p, i, v in items
    ]
    return spark.createDataFrame(data, CHUNKS)
