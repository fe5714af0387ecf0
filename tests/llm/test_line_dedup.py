import random
from itertools import combinations

import numpy as np
import pytest

from lexhound.llm.edit_distance import distances
from lexhound.llm.line_dedup import _BANDS, Closeness, candidates, dedup_lines, line_bounds, line_classes, segments

BLANK = " \t\n\x0b\x0c\r"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, line, edits, letters="abcdé "):
    got = list(line)
    for _ in range(edits):
        what, at = rng.randint(0, 2), rng.randint(0, max(0, len(got) - 1))
        if what == 0 or not got:
            got.insert(at, rng.choice(letters))
        elif what == 1:
            got.pop(at)
        else:
            got[at] = rng.choice(letters)
    return "".join(got)


@pytest.mark.parametrize("bound", range(5))
def test_distances(bound):
    rng = random.Random(bound)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 40)))
        pairs.append((a, edited(rng, a, rng.randint(0, bound + 2), "abé😀")))
    assert distances(pairs, bound).tolist() == [min(levenshtein(a, b), bound + 1) for a, b in pairs]
    long = "x" * 50_000
    assert distances([(long, "y" + long), (long, "z" * 50_000), (long + "ab", long + "ba")], 2).tolist() == [1, 3, 2]


def test_segments_and_bounds():
    assert segments(10, 3) == [(0, 3), (3, 3), (6, 4)]
    texts = [b"ab\ncd", b"", b"\n", b"xy\n\nz\n", b"end"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends = line_bounds(data, np.cumsum([0, *map(len, texts)]))
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"xy", b"z", b"end"]


def near(a, b, close):
    n = min(len(a), len(b))
    allowed = min(close.max_edits, n // close.chars_per_edit)
    if abs(len(a) - len(b)) <= allowed and levenshtein(a, b) <= allowed:
        return True
    most = n // close.chars_per_stretch if close.chars_per_stretch and n >= 48 else 0
    if not most or abs(len(a) - len(b)) > most:
        return False
    begin = next((k for k in range(n) if a[k] != b[k]), n)
    end = next((k for k in range(n - begin) if a[-1 - k] != b[-1 - k]), n - begin)
    return max(len(a), len(b)) - begin - end <= most


def brute(rows, close):
    lines = {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(BLANK):
                lines.setdefault(line, set()).add((doc is None, doc if doc is not None else 0, k))
    linked = {x: set() for x in lines}
    for a, b in combinations(lines, 2):
        if near(a, b, close):
            linked[a].add(b)
            linked[b].add(a)
    head = {}
    for start in lines:
        seen, todo = {start}, [start]
        while todo:
            for y in linked[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        head[start] = min(min(lines[x]) for x in seen)
    return lines, linked, head


def corpus(seed, letters):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(10, 70))) for _ in range(12)]
    # many that share their beginning, or end, and length
    stem = "".join(rng.choice(letters) for _ in range(24))
    base += [stem + "".join(rng.choice(letters) for _ in range(24)) for _ in range(12)] + ["".join(rng.choice(letters) for _ in range(30)) + stem for _ in range(8)]
    rows = []
    for doc in range(40):
        own = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3]), letters) for _ in range(rng.randint(1, 5))]
        rows.append((doc, "\n".join(own)))
    # longer ones that differ in a stretch
    for doc in range(40, 60):
        own = []
        for line in rng.choices(base, k=2):
            n = rng.choice((47, 48, 60, 100, 170))
            line = (line * 20)[:n]
            size, put = rng.randint(0, n // 12), rng.randint(0, n // 12)
            at = rng.choice((0, n - size, rng.randint(0, n - size)))
            own.append(line[:at] + "".join(rng.choice(letters) for _ in range(put)) + line[at + size :])
        rows.append((doc, "\n".join(own)))
    return rows


@pytest.mark.parametrize(
    ("seed", "letters", "hot", "edits", "stretch"), [(1, "abcdefgh é", 10**6, 2, 16), (2, "ab", 1, 2, 0), (3, "abcdefgh", 1, 2, 16), (4, "abc", 2, 1, 16), (5, "abcd", 0, 3, 20), (6, "abcé", 0, 0, 16)]
)
def test_classes_are_those_of_brute_force(spark, seed, letters, hot, edits, stretch):
    rows, close = corpus(seed, letters), Closeness(edits, 9, stretch)
    rows += [(100, None), (101, ""), (102, "  \n\t"), (None, rows[3][1])]
    lines, linked, head = brute(rows, close)
    assert sum(map(len, linked.values())) > 20
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, line string, key int")
    got = line_classes(df, close, hot=hot).collect()
    texts = {d: (t or "").split("\n") for d, t in rows}
    assert len(got) == sum(bool(x.strip(BLANK)) for d in texts.values() for x in d)
    for r in got:
        line = texts[r["doc_id"]][r["line_no"]]
        assert r["n_links"] == len(linked[line]), line
        no_id, doc, k = head[line]
        assert (r["class_doc_id"], r["class_line_no"]) == (doc, k) and not no_id
        assert r["kept"] == ((r["doc_id"], r["line_no"]) == (doc, k))


def test_dedup(spark):
    passage = "This passage of some length stands in several documents."
    rows = [
        (1, f"first own line of the document\n{passage}", "a", 1),
        (2, f"{passage}\nsecond own line, also quite long", "b", 2),
        (3, passage.replace("several", "severel"), "c", 3),
        (4, "short\nshort\n \nanother line that stands alone", "d", 4),
        (4, "short\nshort\n \nanother line that stands alone", "d", 4),
        (5, None, None, None),
        (6, "", "e", 5),
        (7, "The same line twice within one text.\nThe same line twice within one text.", "f", 6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, `row` int")
    got = sorted(dedup_lines(df).collect(), key=lambda r: r["doc_id"])
    assert dedup_lines(df).columns == df.columns
    assert [(r["doc_id"], r["text"], r["gone"], r["row"]) for r in got] == [
        rows[0], (2, "second own line, also quite long", "b", 2), *rows[3:7], (7, "The same line twice within one text.", "f", 6),
    ]
    assert dedup_lines(df.limit(0)).count() == 0 and line_classes(df.limit(0)).count() == 0


def test_many_copies_and_a_very_long_line(spark):
    rows = [(k, "a line that a third of all rows hold, or more") for k in range(300)] + [(1000, "x" * 200_000), (1001, "x" * 199_999 + "y")]
    got = line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_doc_id"], r["n_links"], r["n_copies"]) for r in got} == {(0, 0, 300), (1000, 1, 1)}


def test_any_stretch_is_found(spark):
    """A line of any length near a border of bands, with a stretch of any place and size that still counts."""
    rng, close, rows = random.Random(8), Closeness(), []
    for k, low in enumerate(_BANDS[:14].tolist()):
        for n in (low - 1, low, low * 17 // 16 + 1):
            line = "".join(rng.choice("abcdefgh ") for _ in range(n))
            most = n // 16
            for size, put in ((most, most), (0, most), (most, 0), (1, most)):
                at = rng.choice((0, n - size, n // 2, rng.randint(0, n - size)))
                rows.append((len(rows), line + "\n" + line[:at] + "".join(rng.choice("XYZ") for _ in range(put)) + line[at + size :]))
    for hot in (10**6, 0):
        got = line_classes(spark.createDataFrame(rows, "doc_id long, text string"), close, hot=hot).collect()
        by_line = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["n_links"]) for r in got}
        for doc, text in rows:
            a, b = text.split("\n")
            assert near(a, b, close) or min(len(a), len(b)) < 48 or min(len(a), len(b)) // 16 < max(len(a), len(b)) - min(len(a), len(b))
            if near(a, b, close):
                assert by_line[doc, 0][:2] == by_line[doc, 1][:2], (a, b)


def test_copies_are_indexed_once_a_task(spark):
    rows = [(k, f"a line that all documents hold, however many there are of them, and then some\nown {k} line {k * 7919} of words") for k in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    from lexhound.llm.line_dedup import _keys

    counts = _keys(df, Closeness()).groupBy("id").count().orderBy("count", ascending=False).limit(2).collect()
    assert counts[0]["count"] <= 4 * 32  # tasks, and entries of a line
