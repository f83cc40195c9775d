"""Pages and archives at their worst: extraction against plain walks and in linear time, revisits without headers, hot URLs, damaged files."""

import gzip
import random
import time

import pytest

from tidewatch.llm import extract, warc

REVISITS = "record_id long, url string, seconds long, kind string, status int, digest string, headers map<string,string>"


def plain_second(found, labels, has_article):
    """Each ambiguous block looks for its neighbours by itself."""

    def nearest(i, step):
        j = i + step
        while 0 <= j < len(found):
            if has_article and found[j].inside != found[i].inside:
                break
            if labels[j] in ("good", "bad"):
                return labels[j]
            j += step
        return "good" if has_article and found[i].inside else "bad"

    out = list(labels)
    for i, label in enumerate(labels):
        if label in ("short", "near"):
            a, b = nearest(i, -1), nearest(i, 1)
            if a == b == "good" or label == "near" and "good" in (a, b):
                out[i] = "good"
            elif a == b == "bad":
                out[i] = "good" if label == "near" and (found[i].inside or not has_article) else "bad"
            else:
                out[i] = "good" if found[i].inside or found[i].heading and b == "good" else "bad"
    return out


def test_second_pass_by_plain_search():
    rng = random.Random(1)
    for _ in range(600):
        n = rng.randint(0, 25)
        blocks = [extract.Block("t", 0, False, rng.random() < 0.5, rng.random() < 0.3) for _ in range(n)]
        labels = [rng.choice(("good", "bad", "short", "short", "near")) for _ in range(n)]
        for has_article in (True, False):
            assert extract._second_pass(blocks, labels, has_article) == plain_second(blocks, labels, has_article)


def plain_open(tags):
    """Which tags are open after a row of start and end tags, by walks down the whole stack."""
    stack = []
    for tag in tags:
        if not tag.startswith("/"):
            if tag in ("p", "li") and stack and stack[-1] == tag:
                stack.pop()
            stack.append(tag)
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] == tag[1:]:
                del stack[i:]
                break
            if stack[i] in extract.WALLS and tag[1:] not in extract.BLOCKS:
                break
    return stack


def test_open_tags_by_plain_walks():
    """A block's side and links show what is open when its text comes."""
    rng = random.Random(2)
    names = ["b", "a", "i", "p", "li", "table", "article", "nav", "div", "td"]
    for _ in range(2000):
        tags = [rng.choice(("", "/")) + rng.choice(names) for _ in range(rng.randint(1, 14))]
        found = extract.blocks_of("".join(f"<{t}>" for t in tags) + "word<br>")
        stack = plain_open(tags)
        assert (found[-1].inside, found[-1].aside, found[-1].linked) == ("article" in stack, "nav" in stack, 4 * ("a" in stack)), tags


@pytest.mark.parametrize(
    "page",
    [
        "<p>a short one</p>" * 58_000,
        "<div>" + "<p>and so it was in the house of the old man</p>" * 20_000,
        "<select>" * 125_000,
        "<b>" * 160_000 + "</i>" * 130_000,
        "<b><table>" + "<i>" * 160_000 + "</b>" * 130_000,
        "<article>" + "<b>x</b><p>y" * 80_000,
        "<p>x</article>" * 70_000,
        "<a href='" * 110_000,
        "<" * 1_000_000,
        "&" * 1_000_000,
    ],
)
def test_a_megabyte_takes_seconds(page):
    began = time.process_time()
    extract.main_text(page)
    assert time.process_time() - began < 6


def test_headers_on_one_side_only(spark):
    rows = [
        (1, "http://a.net/1", 10, "response", 200, "d1", None),
        (2, "http://a.net/1", 20, "revisit", 304, None, {"ETag": "e", "Date": "now", "Content-Type": "x"}),
        (3, "http://a.net/2", 10, "response", 200, "d2", {"etag": "e", "date": "then"}),
        (4, "http://a.net/2", 20, "revisit", 304, None, None),
        (5, "http://a.net/3", 10, "response", 200, "d3", None),
        (6, "http://a.net/3", 20, "revisit", 304, None, None),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, REVISITS)).collect()}
    assert got[2].headers == {"etag": "e", "date": "now"} and got[4].headers == {"etag": "e", "date": "then"} and got[6].headers is None
    assert {i: r.resolved_id for i, r in got.items()} == {2: 1, 4: 3, 6: 5}


def test_one_url_many_times_in_a_bucket(spark):
    """Thousands of records of a URL in a few seconds of one bucket: windows get a row a second, and each revisit the last response before its second."""
    rows = [(i, "http://hot.net/", i % 7, "response" if i % 3 else "revisit", 200, f"d{i}", {"n": str(i)}) for i in range(6000)]
    got = {r.record_id: r.resolved_id for r in warc.resolve(spark.createDataFrame(rows, REVISITS)).collect()}
    last = {s: max((i for i, _, t, kind, *_ in rows if t < s and kind == "response"), key=lambda i: (rows[i][2], i), default=None) for s in range(7)}
    assert got == {i: last[s] for i, _, s, kind, *_ in rows if kind == "revisit"}


def record(name, length=None):
    block = b"HTTP/1.1 200 OK\r\nETag: 7\r\n\r\nbody"
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\nWARC-Target-URI: http://a.net/{name}\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_what_follows_damage_is_read_and_the_rest_counted(spark, tmp_path):
    members = [gzip.compress(record(n)) for n in "abcd"]
    broken = bytearray(members[1])
    broken[30:60] = b"\xff" * 30
    (tmp_path / "x.warc.gz").write_bytes(members[0] + bytes(broken) + members[2] + members[3][:-9])
    (tmp_path / "y.warc").write_bytes(record("a") + record("b", "many") + record("c", 10**9) + record("d"))
    (tmp_path / "z.warc").write_bytes(record("a"))
    assert sorted(r.record_id for r in warc.read(spark, f"{tmp_path}/x.warc.gz").collect()) == ["<a>", "<c>"]
    assert sorted(r.record_id for r in warc.read(spark, f"{tmp_path}/y.warc").collect()) == ["<a>", "<d>"]
    counts = {r.path.rpartition("/")[2]: (r.damaged_members, r.damaged_records, r.lost_bytes > 0) for r in warc.damaged(spark, f"{tmp_path}/*").collect()}
    assert counts == {"x.warc.gz": (2, 0, True), "y.warc": (0, 2, True), "z.warc": (0, 0, False)}
