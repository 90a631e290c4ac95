"""A model must not run again because its vectors are used in several places."""

from tests.util import notes_of

from vicinity.operators.embedding import HashEmbedder
from vicinity.operators.index import index_notes, rebuild_index
from vicinity.operators.search import fresh_chunks, related_notes, search_text
from vicinity.schema import Options
from vicinity.sources.tables import overwrite_index, read_index, write_index


class Logged(HashEmbedder):
    """Writes each text it embeds to a file; fails on one text."""

    def __init__(self, log):
        super().__init__(64, max_tokens=128)
        self.log = str(log)

    def __getstate__(self):
        return {**super().__getstate__(), "log": self.log}

    def embed_texts(self, texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("refused")
        with open(self.log, "a") as out:
            out.writelines(repr(t) + "\n" for t in texts)
        return super().embed_texts(texts)

    def taken(self):
        with open(self.log) as lines:
            found = lines.read().splitlines()
        open(self.log, "w").close()
        return sorted(found)


def corpus(spark, n=6):
    return notes_of(spark, *[(f"{i}.md", f"word{i} common text") for i in range(n)])


def test_index_and_rebuild(spark, tmp_path):
    model = Logged(tmp_path / "log")
    once = sorted(repr(f"{i}\n\nword{i} common text") for i in range(6))
    made = index_notes(corpus(spark), model).drop("error")
    write_index(made, str(tmp_path / "a"))
    assert model.taken() == once
    overwrite_index(rebuild_index(corpus(spark), model), str(tmp_path / "b"))
    assert model.taken() == once
    assert read_index(spark, str(tmp_path / "a")).count() == 6 and model.taken() == []


def test_a_failed_note_is_left_out_of_a_rebuild(spark, tmp_path):
    model = Logged(tmp_path / "log")
    long = " ".join(["fine"] * 400) + "\n\n" + "poison"
    notes = notes_of(spark, ("bad.md", long), ("good.md", "fine"))
    got = rebuild_index(notes, model, Options(chunk_size=128))
    assert {r.path for r in got.collect()} == {"good.md"}


def test_searches(spark, tmp_path):
    model = Logged(tmp_path / "log")
    write_index(index_notes(corpus(spark), model).drop("error"), str(tmp_path / "a"))
    index = read_index(spark, str(tmp_path / "a"))
    model.taken()
    queries = spark.createDataFrame([(str(i), f"word{i}") for i in range(5)], "query_id string, text string")
    for plan in ("broadcast", "cells"):
        assert search_text(queries, index, model, plan=plan).filter("rank = 1").count() == 5
        assert model.taken() == sorted(repr(f"word{i}") for i in range(5))
    new = notes_of(spark, *[(f"new{i}.md", f"word{i} again") for i in range(3)])
    for plan in ("broadcast", "cells"):
        fresh = fresh_chunks(new, index, model)
        found = related_notes(index, fresh, fresh=fresh, limit=1, plan=plan)
        assert {r.source_path for r in found.collect()} == {f"new{i}.md" for i in range(3)}
        assert len(model.taken()) == 3
