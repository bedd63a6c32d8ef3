"""Line dedup and token rollups against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from rowmend.llm.lines import drop_boilerplate
from rowmend.llm.rollups import Rollup, byte_estimate, changes, piece_count, word_count
from rowmend.sources.workspace import new_path, remove


def plain_lines(data, ratio, least):
    pages, met = {}, {}
    for _, text, host in data:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            met[host, line] = met.get((host, line), 0) + 1

    def cut(text, host):
        if text is None:
            return None
        return "\n".join(x for x in text.split("\n") if x.strip(" \t\r") == "" or not (
            met[host, x.strip(" \t\r")] >= least and met[host, x.strip(" \t\r")] > ratio * pages[host]))

    return sorted(((i, cut(t, h), h) for i, t, h in data), key=str)


@pytest.mark.parametrize("ratio, least", [(0.05, 3), (0.3, 1), (1.0, 1), (0.0, 2)])
def test_lines_by_host(docs, ratio, least):
    r = random.Random(2)
    lines = ["Home | About", " Home | About\t", "", "  ", "Copyright", "x\r", "é ü", "a.b*c"] + [f"line {i}" for i in range(30)]
    data = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 9))), r.choice(["a", "b", None])) for i in range(150)]
    data += [(1, None, "a"), (2, "", "b"), (3, "Home | About", "lonely"), (None, "Copyright", "a"), (4, "z " * 90_000, "a")]
    data += [(5, "Copyright\nCopyright", "a")] * 2
    table = docs([(i, t, "en", h) for i, t, h in data])
    got = drop_boilerplate(table, ratio=ratio, min_pages=least, dropped_col="n")
    assert set(got.columns) == set(table.columns)
    rows = got.collect()
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in rows), key=str) == plain_lines(data, ratio, least)
    lost = {(r["doc_id"], r["source"]): r["n"] for r in rows}
    assert lost[3, "lonely"] == (least == 1 and ratio < 1) and lost[2, "b"] == 0


def test_lines_of_nothing(docs, no_rows):
    table = docs([(1, "a")])
    assert drop_boilerplate(no_rows(table)).count() == 0
    with pytest.raises(ValueError):
        drop_boilerplate(table, ratio=1.5)


def test_counts(rows):
    texts = ["", None, " a  b\x0bc\n", "Don't, 12!", "é中 x"]
    table = rows([(t,) for t in texts], "text string")
    got = table.select(word_count(F.col("text")), piece_count(F.col("text")), byte_estimate(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (0, 0, 0), (3, 3, 2), (2, 7, 3), (2, 2, 2)]


SCHEMA = "doc_id long, source string, lang string, tokenizer string, operation string, sequence long, tokens long, docs string"


def batches(seed, count=6, size=60):
    r = random.Random(seed)
    for _ in range(count):
        yield [(r.choice([None, *range(25)]), r.choice(["a", "b", None]), r.choice(["en", "de", None]), r.choice(["t1", "t2"]),
                r.choice(["insert", "delete", "revise", "odd"]), n, r.choice([None, 0, 5, 17]), "x") for n in range(size)]


def plain_totals(all_batches):
    state = {}
    for batch in all_batches:
        for doc, source, lang, tokenizer, operation, _, tokens, _ in batch:
            if doc is None or operation == "odd":
                continue
            state.pop((doc, tokenizer), None)
            if operation != "delete":
                state[doc, tokenizer] = (source, lang, tokens or 0)
    totals = {}
    for (_, tokenizer), (source, lang, tokens) in state.items():
        n, t = totals.get((source, lang, tokenizer), (0, 0))
        totals[source, lang, tokenizer] = n + 1, t + tokens
    return totals


def totals_of(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_batches_and_replays(spark, rows):
    rollup, done = Rollup(spark, new_path(spark, "rollup")), []
    assert totals_of(rollup) == {}
    for number, batch in enumerate(batches(1, count=4)):
        table = rows(batch, SCHEMA)
        done.append(batch)
        assert rollup.commit(f"b{number}", table) is True
        assert totals_of(rollup) == plain_totals(done)
        assert rollup.commit(f"b{number}", rows(batch * 2, SCHEMA)) is False
        assert totals_of(rollup) == plain_totals(done)
    assert rollup.commit("empty", rows([], SCHEMA)) and totals_of(rollup) == plain_totals(done)
    kept = {(r["doc_id"], r["tokenizer"]) for r in rollup.current().collect()}
    assert len(kept) == rollup.current().count() == sum(n for n, _ in plain_totals(done).values())


def test_broken_commits_are_written_anew(spark, rows):
    rollup = Rollup(spark, new_path(spark, "rollup"))
    first, second = list(batches(4, count=2))
    rollup.commit("one", rows(first, SCHEMA))
    rollup.commit("two", rows(second, SCHEMA))
    want = plain_totals([first, second])
    remove(spark, f"{rollup.folder}/deltas/two/_SUCCESS")
    assert totals_of(rollup) == plain_totals([first])
    assert rollup.commit("two", rows(second, SCHEMA)) is False and totals_of(rollup) == want
    remove(spark, f"{rollup.folder}/entries/two/_SUCCESS")
    remove(spark, f"{rollup.folder}/deltas/two")
    assert rollup.commit("two", rows(second, SCHEMA)) is True and totals_of(rollup) == want


def test_changes_are_checked(docs, spark):
    table = docs([(1, "a b")])
    with pytest.raises(ValueError):
        changes(table, "update", "t", F.lit(1))
    with pytest.raises(ValueError):
        Rollup(spark, "x").commit("_hidden", table)
    assert changes(table, "insert", "t", word_count(F.col("text"))).first()["tokens"] == 2
