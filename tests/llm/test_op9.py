import random

from sparkmarts.llm.op9_line_dedup import BLANK, dedup_lines, keys_of, near_links, line_rows, within
from sparkmarts.llm.queries import op9_line_dedup
from tests.llm.helpers import ODD_ROWS, docs_frame


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def changed(draw, line, edits):
    for _ in range(edits):
        at = draw.randint(0, len(line))
        line = draw.choice((line[:at] + "q" + line[at:], line[:at] + line[at + 1:],
                            line[:at] + "z" + line[at + 1:]))
    return line


def test_distance_and_keys_lose_no_pair():
    draw = random.Random(2)
    for _ in range(4000):
        a = "".join(draw.choice("abé ") for _ in range(draw.randint(0, 150)))
        b = changed(draw, a, draw.randint(0, 4))
        for most in (1, 2, 3):
            near = distance(a, b) <= most
            assert within(a, b, most) == within(b, a, most) == near
            if near and min(len(a), len(b)) >= 8:
                x, y = sorted((a, b), key=len)
                index = {k for k, r in keys_of(x, most, 8).items() if r & 1}
                assert index & {k for k, r in keys_of(y, most, 8).items() if r & 2}


def brute(rows, max_edits=2, min_chars=24):
    """(id, kept text, lines, removed) by comparing every line with all earlier ones."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    earlier, out, before = set(), [], {}
    for i in order:
        key, text = rows[i]
        kept, n, gone = [], 0, 0
        for number, line in enumerate([] if text is None else text.split("\n")):
            c = line.strip(BLANK)
            if not c:
                kept.append(line)
                continue
            n += 1
            hit = c in earlier or len(c) >= min_chars and any(
                len(e) >= min_chars and abs(len(e) - len(c)) <= max_edits
                and distance(e, c) <= max_edits for e in earlier)
            earlier.add(c)
            gone += hit
            if not hit:
                kept.append(line)
        out.append((key, None if text is None else "\n".join(kept) if n > gone or not n else "", n, gone))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)


def test_lines_of_near_copies(spark):
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(20, 90))) for _ in range(25)]
    rows = [(i, "\n".join(changed(draw, draw.choice(base), draw.choice((0, 0, 1, 2, 3)))
                          if draw.random() < 0.7 else draw.choice(("", "  ", "short", "x" * 30 + str(i)))
                          for _ in range(draw.randint(0, 8)))) for i in range(60)]
    df = docs_frame(spark, rows)
    got = dedup_lines(df.repartition(3))
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert result(got) == brute(rows)


def test_hot_keys_are_split(spark):
    draw = random.Random(6)
    tail = "the same long ending of every line in this table"
    rows = [(i, "".join(draw.choice("abcdefgh") for _ in range(24)) + tail) for i in range(150)]
    rows += [(200 + i, changed(draw, t, 2)) for i, (_, t) in enumerate(rows[:40])]
    df = docs_frame(spark, rows)
    links = near_links(df, 2, 24, "doc_id", "text", block_rows=16)
    late = {r.h1 for r in links.collect()}
    hashes = {r.id: r.h1 for r in line_rows(df, "doc_id", "text").collect()}
    want = {hashes[key] for key, _, _, gone in brute(rows) if gone}
    assert late == want and len(late) >= 30


def test_odd_rows(spark):
    df = docs_frame(spark, ODD_ROWS)
    assert result(dedup_lines(df)) == brute(ODD_ROWS)
    assert dedup_lines(df.limit(0)).count() == 0
    twice = docs_frame(spark, [(1, "one line of text that is long"), (1, "one line of text that is long")])
    assert [r.n_removed for r in dedup_lines(twice).collect()] == [0, 0]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_chars) for r in op9_line_dedup(spark, sf).collect()}
    # by distance only where lengths and a segment allow: the exact part here, near lines above
    exact = brute(rows, max_edits=0, min_chars=10**9)
    assert set(got) == {k for k, *_ in exact}
    assert all(got[k][0] == n and got[k][1] >= gone for k, _, n, gone in exact)


def test_texts_are_rebuilt_without_python(spark):
    # Arrow batches of whole texts took over 3000 MB of an executor
    rows = [(1, "one\n\n two \none"), (1, "three\n"), (2, "two\nfour\n\t\none"), (3, "one"), (4, None), (5, "\n \n"),
            (None, "five\ntwo"), (6, "\n".join(str(n) for n in range(3000))), (7, "x\n" * 500 + "2999\ny")]
    df = docs_frame(spark, rows)
    got = dedup_lines(df)
    assert "InArrow" not in got._jdf.queryExecution().toString()
    texts = sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], key=str)
    # rows of one id count as one document; its lines of a number are kept together
    assert texts == sorted([
        (1, "one\n", 3, 2), (1, "three\n", 1, 0), (2, "four\n\t", 3, 2), (3, "", 1, 1), (4, None, 0, 0),
        (5, "\n \n", 0, 0), (None, "five\ntwo", 2, 0), (6, rows[7][1], 3000, 0), (7, "x\n" + "y", 502, 500)],
        key=str)
    plain = dedup_lines(df, counts=False)
    assert plain.columns == df.columns and plain.count() == len(rows)
