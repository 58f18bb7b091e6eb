from loomspan.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines string"


def brute(rows, least):
    sites, first = {}, {}
    for i, t, s in rows:
        for p, x in enumerate((t or "").split("\n") if t is not None else []):
            k = x.strip(" ")
            if len(k) >= line_dedup.MIN_LENGTH:
                sites.setdefault(k, set()).add(s or "")
                first[k] = min(first.get(k, (i, p)), (i, p))
    out = {}
    for i, t, _ in rows:
        if t is None:
            out[i] = (None, 0)
            continue
        lines = t.split("\n")
        kept = [x for p, x in enumerate(lines) if len(sites.get(x.strip(" "), ())) < least or first[x.strip(" ")] == (i, p)]
        out[i] = ("\n".join(kept), len(lines) - len(kept))
    return out


def test_equals_brute_force(spark):
    rows = []
    for i in range(400):
        lines = [f"own line number {i}", f"  spread {i % 3} over many sites " if i % 2 else "short", f"near threshold {i % 40 // 4} here", "", "hot line on every page"]
        rows.append((i, "\n".join(lines[: 2 + i % 4]), f"site{i % 23}"))
    rows += [(500, None, "x"), (501, "", None), (502, "hot line on every page\nhot line on every page", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    for least in (2, 8, 20):
        got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_boilerplate(docs, min_sites=least).collect()}
        assert got == brute(rows, least)


def test_awkward_rows(awkward, empty):
    got = line_dedup.remove_boilerplate(awkward)
    assert got.count() == awkward.count() and got.columns == [*awkward.columns, "n_lines", "n_removed"]
    assert {r._k1 for r in got.collect()} == {"k"}  # a column of the table, not the key
    assert line_dedup.remove_boilerplate(empty).collect() == []


def test_without_a_site_column_nothing_is_spread(spark):
    docs = spark.createDataFrame([(i, "the same line everywhere") for i in range(30)], "doc_id long, text string")
    assert line_dedup.remove_boilerplate(docs).filter("n_removed > 0").count() == 0


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"line {i % 2} on many sites\nown {i}", f"s{i}", "") for i in range(60)], SCHEMA)
    want = sorted(tuple(r) for r in line_dedup.remove_boilerplate(docs).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(tuple(r) for r in line_dedup.remove_boilerplate(docs).collect()) == want
