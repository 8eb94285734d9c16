"""Archives: round trip of any payload, revisits, and the merged order."""

import hashlib
import heapq
import random

from rideledger.llm import warc
from rideledger.llm.warc import LoserTree, histories, parsed, records, url_key

SCHEMA = "page_id bigint, url string, html string, key string, position string"


def corpus(seed):
    rng = random.Random(seed)
    big = ["<p>" + "x" * 1200, "é" * 600, "WARC/1.1\r\n\r\n" * 100, "y" * 999]
    rows = []
    for i in range(150):
        html = rng.choice([*big, *big, "", None, "\r\n\r\n", f"page {i}", "z" * rng.randrange(900, 1100), "Content-Length: 5\r\n\r\n" + "q" * 1000])
        rows.append((i, rng.choice(["http://www.Example.com/a?b=1#c", "https://b.example.com", None, "", "http://x.org/" + "é" * 3, "no url\r\nWARC-Type: x", "http://[bad"]), html, "k", "p"))
    rows += [(None, "http://n.org/", big[0], "", ""), (149, "http://same.org/", rows[149][2], "", ""), (-5, "http://minus.org/", big[1], "", ""), (2**62, "u", "w" * 1500, "", ""), (-(2**62), "u", "w" * 1500, "", "")]
    rng.shuffle(rows)
    return rows


def check(rows, got):
    assert len(got) == len(rows)
    largest = {}
    for key, _, html, *_ in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and key is not None:
            largest[payload] = max(key, largest.get(payload, key))
    want = []
    for key, _, html, *_ in rows:
        payload = (html or "").encode()
        keeper = largest.get(payload)
        again = keeper is not None and keeper != key
        want.append((key, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", keeper if again else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    got = sorted(got, key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    order = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)


def test_round_trip(spark):
    rows = corpus(1)
    check(rows, histories(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())


def test_many_ranges_and_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 9)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 13)
    rows = corpus(2)
    found = histories(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    check(rows, found)
    assert len({row.archive for row in found}) > 10


def test_records_stand_for_themselves(spark):
    rows = corpus(3)
    for (value,) in records(spark.createDataFrame(rows, SCHEMA)).collect():
        ((at, fields, block),) = parsed((value + "\r\n\r\n").encode())
        assert at == 0 and int(fields["Content-Length"]) == len(block)
        assert fields["WARC-Type"] in ("response", "revisit") and (fields["WARC-Type"] == "revisit") == ("WARC-Refers-To" in fields)


def test_loser_tree():
    rng = random.Random(4)
    for count in (0, 1, 2, 3, 7, 8, 30):
        lists = [sorted(rng.choices("abcdefgh", k=rng.randrange(6))) for _ in range(count)]
        got = list(LoserTree(lists))
        assert [lists[i][j] for i, j in got] == list(heapq.merge(*lists))
        assert sorted(got) == sorted((i, j) for i, held in enumerate(lists) for j in range(len(held)))
        assert got == sorted(got, key=lambda at: (lists[at[0]][at[1]], *at))


def test_url_keys():
    assert url_key("https://www.Sub.Example.com:80/a/b?x=1#top") == "com,example,sub)/a/b?x=1"
    assert url_key("http://example.com") == "com,example)/"
    assert url_key(None) == url_key("") == ""


def test_empty_table(spark):
    assert histories(spark.createDataFrame([], SCHEMA)).collect() == []
