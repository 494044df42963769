"""Readers and writers by round trips, and streams against tables."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from atlasframe.operators import importing
from atlasframe.sources import files
from atlasframe.streaming import agents


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def packed(values, signed=False):
    return b"".join(varint((v << 1) ^ (v >> 63) if signed else v) for v in values)


def delta(values):
    return packed(np.diff(values, prepend=0).tolist(), True)


def test_pbf(spark, tmp_path):
    words = [b"", b"highway", b"primary", b"name", "Größe".encode(), b"outer"]
    dense = field(1, delta([5, 7])) + field(8, delta([515000000, 515000010])) + field(9, delta([75000000, -75000000])) + field(10, packed([3, 4, 0, 0]))
    way = field(1, 99) + field(2, packed([1])) + field(3, packed([2])) + field(8, delta([5, 7, 5]))
    relation = field(1, 3) + field(8, packed([5])) + field(9, delta([99])) + field(10, packed([1]))
    block = field(1, b"".join(field(1, w) for w in words)) + field(2, field(2, dense)) + field(2, field(3, way)) + field(2, field(4, relation))
    blob = field(2, len(block)) + field(3, zlib.compress(block))
    header = field(1, b"OSMData") + field(3, len(blob))
    (tmp_path / "a.pbf").write_bytes(struct.pack(">I", len(header)) + header + blob)
    t = files.read_osm(spark, [f"file://{tmp_path}/a.pbf"])
    nodes = {r.id: r for r in t["nodes"].collect()}
    assert (nodes[5].lat, nodes[5].lon, nodes[5].tags) == (51.5, 7.5, {"name": "Größe"}) and nodes[7].lon == -7.5 and nodes[7].tags == {}
    assert [(r.id, r.refs, r.tags) for r in t["ways"].collect()] == [(99, [5, 7, 5], {"highway": "primary"})]
    assert [(r.id, [tuple(m) for m in r.members]) for r in t["relations"].collect()] == [(3, [("way", 99, "outer")])]


def pbf_file(path, nodes, ways, relations, per_blob=50):
    """A file of a header and a blob for each per_blob objects of a kind."""

    def blob(kind, content):
        data = field(2, len(content)) + field(3, zlib.compress(content))
        header = field(1, kind) + field(3, len(data))
        return struct.pack(">I", len(header)) + header + data

    out = [blob(b"OSMHeader", field(4, b"OsmSchema-V0.6"))]
    for kind, rows in (("node", nodes), ("way", ways), ("relation", relations)):
        for a in range(0, len(rows), per_blob):
            part = rows[a : a + per_blob]
            words = [""]
            word = lambda w: words.index(w) if w in words else (words.append(w) or len(words) - 1)  # noqa: B023, E731
            pairs = lambda tags: field(2, packed([word(k) for k in tags])) + field(3, packed([word(v) for v in tags.values()]))
            if kind == "node":
                tagged = [x for i, _, _, tags in part for x in [*(y for k, v in tags.items() for y in (word(k), word(v))), 0]]
                group = field(2, field(1, delta([r[0] for r in part])) + field(8, delta([round(r[1] * 1e7) for r in part])) + field(9, delta([round(r[2] * 1e7) for r in part])) + field(10, packed(tagged)))
            elif kind == "way":
                group = b"".join(field(3, field(1, i) + pairs(tags) + field(8, delta(refs))) for i, refs, tags in part)
            else:
                group = b"".join(field(4, field(1, i) + pairs(tags) + field(8, packed([word(role) for _, _, role in members])) + field(9, delta([m for _, m, _ in members])) + field(10, packed([("node", "way", "relation").index(k) for k, _, _ in members]))) for i, members, tags in part)
            out.append(blob(b"OSMData", field(1, b"".join(field(1, w.encode()) for w in words)) + field(2, group)))
    path.write_bytes(b"".join(out))


def test_pbf_of_many_blobs_equals_xml_and_is_read_in_ranges(spark, tmp_path):
    from xml.sax.saxutils import quoteattr

    nodes = [(k, 50 + k / 1000, -7 + k / 500, {"name": f"Ort {k}", "größe": "ß"} if k % 3 == 0 else {}) for k in range(1, 401)]
    ways = [(1000 + k, [1 + (k * 7 + j) % 400 for j in range(k % 9)], {"highway": "primary"} if k % 2 else {}) for k in range(160)]
    relations = [(5000 + k, [(("node", "way", "relation")[j % 3], 1 + j * k, "outer" if j % 2 else "") for j in range(k % 4)], {"type": "route"}) for k in range(70)]
    pbf_file(tmp_path / "a.pbf", nodes, ways, relations)
    tags = lambda t: "".join(f"<tag k={quoteattr(k)} v={quoteattr(v)}/>" for k, v in t.items())
    xml = "".join(f'<node id="{i}" lat="{lat!r}" lon="{lon!r}">{tags(t)}</node>' for i, lat, lon, t in nodes)
    xml += "".join(f'<way id="{i}">{"".join(f"<nd ref={quoteattr(str(r))}/>" for r in refs)}{tags(t)}</way>' for i, refs, t in ways)
    xml += "".join(f'<relation id="{i}">{"".join(f"<member type={quoteattr(k)} ref={quoteattr(str(m))} role={quoteattr(role)}/>" for k, m, role in members)}{tags(t)}</relation>' for i, members, t in relations)
    (tmp_path / "a.osm").write_text(f"<osm>{xml}</osm>")
    got, want = files.read_osm_pbf(spark, f"file://{tmp_path}/a.pbf", partition_bytes=1000), files.read_osm_xml(spark, f"file://{tmp_path}/a.osm")
    plain = lambda t: {k: sorted((repr(r.asDict(True) | ({"lat": round(r.lat, 7), "lon": round(r.lon, 7)} if k == "nodes" else {})) for r in t[k].collect())) for k in t}
    assert plain(got) == plain(want) and [t.count() for t in got.values()] == [400, 160, 70]
    ranges = spark.read.format("osm_pbf").option("partition_bytes", 500).load(f"{tmp_path}/a.pbf")
    assert ranges.rdd.getNumPartitions() >= 5 and ranges.count() == 630
    one = spark.read.format("osm_pbf").load(f"{tmp_path}")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 630


def test_pbf_header_alone_and_cut_files(spark, tmp_path):
    import pytest

    pbf_file(tmp_path / "none.pbf", [], [], [])
    assert files.read_osm_pbf(spark, f"{tmp_path}/none.pbf")["nodes"].count() == 0
    pbf_file(tmp_path / "cut.pbf", [(1, 1.0, 1.0, {})], [], [])
    (tmp_path / "cut.pbf").write_bytes((tmp_path / "cut.pbf").read_bytes()[:-3])
    with pytest.raises(Exception, match="ends within the blob"):
        files.read_osm_pbf(spark, f"{tmp_path}/cut.pbf")["nodes"].count()


def test_catalogues_of_any_depth_and_databases_that_lack_tables(spark, tmp_path):
    import json

    entry = {"name": "map 7", "directory": "d7", "size": 7, "version": 1, "timestamp": 7}
    for k in range(6, -1, -1):
        entry = {"name": f"folder {k}", "dir": [entry, {"name": f"map {k}", "directory": f"d{k}", "size": k, "version": 1, "timestamp": k}]}
    (tmp_path / "maps.json").write_text(json.dumps([entry]))
    found = {r.name: r.path for r in files.map_catalogue(spark, f"file://{tmp_path}/maps.json").collect()}
    assert set(found) == {f"map {k}" for k in range(8)} and found["map 7"] == "/".join(f"folder {k}" for k in range(7)) + "/map 7"
    a, b = spark.createDataFrame([(1, "x")], "id long, name string"), spark.createDataFrame([(2,)], "id long")
    files.save_database({"nodes": a, "extra": b}, f"{tmp_path}/one")
    files.save_database({"nodes": b}, f"{tmp_path}/two")
    t = files.open_databases(spark, [f"{tmp_path}/one", f"{tmp_path}/two"])
    assert sorted(map(tuple, t["nodes"].select("id", "name", "db_id").collect())) == [(1, "x", 0), (2, None, 1)] and t["extra"].count() == 1


def test_xml_and_database(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="51.5" lon="7.5"><tag k="name" v="A"/></node><way id="2"><nd ref="1"/><nd ref="3"/></way></osm>')
    t = files.read_osm(spark, [f"file://{tmp_path}/a.osm"])
    assert [(r.id, r.tags) for r in t["nodes"].collect()] == [(1, {"name": "A"})] and t["ways"].first().refs == [1, 3]
    files.save_database({"nodes": t["nodes"]}, f"{tmp_path}/db")
    assert files.open_databases(spark, [f"{tmp_path}/db", f"{tmp_path}/db"])["nodes"].select("db_id").distinct().count() == 2


def test_gpx_poly_and_heights(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, k, 51.5 + k / 100, 7.5, None if k == 1 else 100.0 + k) for k in range(3)], "track long, seg int, idx int, lat double, lon double, ele double").withColumn("ts", F.timestamp_seconds(F.col("idx")))
    (tmp_path / "a.gpx").write_text(files.gpx_documents(points).first().gpx)
    back = files.read_gpx(spark, f"file://{tmp_path}/a.gpx").orderBy("idx").collect()
    assert [(r.idx, round(r.lat, 6), r.ele) for r in back] == [(0, 51.5, 100.0), (1, 51.51, None), (2, 51.52, 102.0)] and back[2].ts.second == 2
    (tmp_path / "a.poly").write_text("title\n1\n 7.0 51.0\n 8.0 51.0\n 8.0 52.0\n 7.0 51.0\nEND\nEND\n")
    r = files.read_poly(spark, f"file://{tmp_path}/a.poly").collect()
    assert len(r) == 1 and r[0].name == "1" and [(p.lat, p.lon) for p in r[0].ring] == [(51.0, 7.0), (51.0, 8.0), (52.0, 8.0)]
    (tmp_path / "N51E007.hgt").write_bytes(np.array([[1, 2], [-32768, 300]], ">i2").tobytes())
    assert {(r.row, r.col): r.height for r in files.read_heights(spark, f"file://{tmp_path}/N51E007.hgt").collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): None, (1, 1): 300}


def test_chains(spark):
    links = [(1, 2), (2, 3), (3, None), (9, 8), (8, 7), (7, 9), (20, None)]
    found = {r.id: (r.head, r.pos) for r in importing.chains(spark.createDataFrame(links, "id long, next_id long")).collect()}
    assert found == {1: (1, 0), 2: (1, 1), 3: (1, 2), 7: (7, 0), 9: (7, 1), 8: (7, 2), 20: (20, 0)}


def test_stream_equals_table(spark, tmp_path):
    rows = [(v, 100 + 2 * k, 48 + k * 0.0003 * (v + 1), 8 + (k % 5) * 0.0002, 5.0, None if k % 3 else 4.0, k % 4 != 0, f"s{k // 6}") for v in range(2) for k in range(30)]
    table = spark.createDataFrame(rows, "vehicle long, s long, lat double, lon double, accuracy double, speed double, on_route boolean, street string").select("vehicle", F.timestamp_seconds("s").alias("ts"), "lat", "lon", "accuracy", "speed", "on_route", "street")
    for part, at in ((0, "s < 130"), (1, "s >= 130")):
        table.withColumn("s", F.unix_seconds("ts")).where(at).drop("s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for agent in (agents.SPEED, agents.STREET, agents.route_state((48.008, 8.0))):
        q = agents.over_stream(stream, agent).writeStream.format("memory").queryName(f"out_{agent.name}").option("checkpointLocation", f"{tmp_path}/{agent.name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        expected = sorted(map(tuple, agents.over_table(table, agent).collect()))
        assert sorted(map(tuple, spark.table(f"out_{agent.name}").collect())) == expected and expected
