import gzip
import hashlib

import pytest

from entigraph.llm import warc

SCHEMA = "page_id long, url string, html string, payload int, owner int"


def brute(rows, least=1000):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        owner = max(same) if same and len(body) >= least else None
        revisit = owner is not None and owner != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


def corpus():
    big = "<p>é</p>" * 300
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"<html>{i}</html>" * (1 + i % 90)) for i in range(200)]
    return rows + [(300, None, None), (301, "http://h/\r\nX: y é", ""), (302, "u", "short"), (303, "u", "short"), (None, "u", big), (198, "http://h/198", big), (400, "u", "a\r\n\r\nb" * 400_000)]


def test_round_trip(spark):
    rows = corpus()
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = warc.round_trip(pages)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_archives_are_plain_warc_and_predicates_reach_the_scan(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1, 2) for r in corpus()], SCHEMA)
    path = str(tmp_path / "w")
    warc.write_pages(pages.coalesce(2), path)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.gz")))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(corpus())
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(raw)
    for folder in (path, str(tmp_path / "plain")):
        read = spark.read.format("warc").load(folder)
        revisits = read.where("record_type = 'revisit'")
        assert revisits.count() == sum(r[3] == "revisit" for r in brute(corpus()))
        assert read.where("page_id in ('4', '5')").count() == 2
        assert spark.read.format("warc").option("header.X-Page-Id", "7").option("payload", "false").load(folder).collect()[0].payload is None


def test_filters_are_taken():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = warc.WarcReader({"path": "x"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringStartsWith(("target_uri",), "http://h/"), GreaterThan(("payload_bytes",), "5")]))
    assert left == [GreaterThan(("payload_bytes",), "5")]
    assert reader.wanted({"warc-type": "revisit", "warc-target-uri": "http://h/1"})
    assert not reader.wanted({"warc-type": "response", "warc-target-uri": "http://h/1"})


def test_reader_skips_what_headers_reject(tmp_path):
    class Counting:
        def __init__(self, data):
            import io

            self.f, self.n, self.len = io.BytesIO(data), 0, len(data)

        def seek(self, at):
            return self.f.seek(at)

        def tell(self):
            return self.f.tell()

        def size(self):
            return self.len

        def read(self, n):
            got = self.f.read(n)
            self.n += len(got)
            return got

    import random

    rng = random.Random(0)
    rows = [{"page_id": i, "url": "u", "record_type": "response", "refers_to": None, "payload_digest": "x", "payload_bytes": 200_000, "payload": rng.randbytes(200_000)} for i in range(10)]
    stream = Counting(b"".join(warc.member(warc.record(r)) for r in rows))
    got = list(warc._records(warc.Inflated(stream), warc.Wanted(equal={"x-page-id": {"9"}}), True))
    assert len(got) == 1 and warc.payload_of(*got[0][1:]) == rows[9]["payload"]
    assert stream.n < stream.len / 2


def by_hand(names=str, n=5):
    """Archives as other writers make them."""
    out = []
    for i in range(n):
        body = f"HTTP/1.1 200 OK\r\n\r\nbody {i} é".encode() * (1 + 3000 * (i == 2))
        head = "".join(f"{names(k)}: {v}\r\n" for k, v in (("WARC-Type", "response" if i % 2 else "request"), ("WARC-Target-URI", f"http://h/{i}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))))
        out.append((f"WARC/1.0\r\n{head}X-Long: a\r\n b\r\n\r\n".encode() + body + b"\r\n\r\n", body.partition(b"\r\n\r\n")[2]))
    return [o[0] for o in out], [o[1] for o in out]


@pytest.mark.parametrize("names", [str, str.lower, str.upper])
@pytest.mark.parametrize("layout", ["plain", "one member", "each its own", "stated", "three members", "split anywhere"])
def test_archives_of_other_writers(spark, tmp_path, names, layout):
    records, bodies = by_hand(names)
    whole = b"".join(records)
    data = {
        "plain": lambda: whole,
        "one member": lambda: gzip.compress(whole),
        "each its own": lambda: b"".join(map(gzip.compress, records)),
        "stated": lambda: warc.member(records[0] + records[1]) + b"".join(map(warc.member, records[2:])),
        "three members": lambda: gzip.compress(records[0]) + gzip.compress(b"".join(records[1:4])) + gzip.compress(records[4]),
        "split anywhere": lambda: b"".join(gzip.compress(whole[i : i + 777]) for i in range(0, len(whole), 777)),
    }[layout]()
    (tmp_path / ("a.warc" if layout == "plain" else "a.warc.gz")).write_bytes(data)
    warc.register(spark)
    read = spark.read.format("warc").load(str(tmp_path))
    got = {r.target_uri: (r.record_type, bytes(r.payload)) for r in read.collect()}
    assert got == {f"http://h/{i}": ("response" if i % 2 else "request", b) for i, b in enumerate(bodies)}
    assert sorted(r.target_uri[-1] for r in read.where("record_type = 'response'").collect()) == ["1", "3"]
    assert {r.target_uri[-1] for r in spark.read.format("warc").option("payload", "false").option("header.x-long", "a b").load(str(tmp_path)).collect()} == set("01234")


@pytest.mark.parametrize("spoil", [lambda raw: raw[:-9], lambda raw: raw + b"rest", lambda raw: b"<html>" + raw])
def test_what_is_no_record_raises(spoil):
    import io

    raw = spoil(b"".join(by_hand()[0]))
    for source in (warc.Plain(io.BytesIO(raw)), warc.Inflated(io.BytesIO(gzip.compress(raw)))):
        with pytest.raises(ValueError):
            list(warc._records(source, warc.Wanted(), True))
    with pytest.raises(ValueError):
        list(warc._records(warc.Inflated(io.BytesIO(gzip.compress(raw)[:-40])), warc.Wanted(), True))


def test_record_ids_differ(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "b"), (2, "u", "x" * 2000), (3, "u", "x" * 2000), (None, "u", "a"), (None, "v", "a")]
    warc.write_pages(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), str(tmp_path / "w"))
    got = spark.read.format("warc").load(str(tmp_path / "w")).collect()
    assert len({r.record_id for r in got}) == len(rows)
    assert {r.refers_to for r in got} - {None} == {r.record_id for r in got if r.page_id == "3"}


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
