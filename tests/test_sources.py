import itertools
import json
import struct
import zlib

import numpy as np
import pytest

from sightline import api
from sightline.operators import kernel, segments
from sightline.plans.metadata import settings_of
from sightline.settings import Settings
from sightline.sources import dem, sinks, tiff

from .test_sight import HILL, POVS

CENTRE = (33.33, 33.33)


@pytest.fixture
def hill_file(tmp_path):
    path = str(tmp_path / "hill.tiff")
    tiff.write(path, 12, 1.0, CENTRE, iter(np.array(HILL).reshape(12, 12)), np.int16)
    return path


def test_raster_there_and_back(spark, hill_file):
    rows, settings = dem.read_dem(spark, hill_file, observer_height=0.8)
    assert [r["elev"] for r in rows.orderBy("dem_id").collect()] == HILL
    assert (settings.width, settings.scale, settings.centre) == (12, 1.0, CENTRE)


def test_unsigned_rasters_are_moved(tmp_path):
    assert list(tiff.elevations(np.array([0, 32767, 65534], np.uint16))) == [-32767, 0, 32767]
    with pytest.raises(ValueError):
        tiff.elevations(np.array([65535], np.uint16))
    with pytest.raises(ValueError):
        tiff.elevations(np.array([1.0], np.float32))


def test_rasters_are_checked(tmp_path, hill_file):
    with open(tmp_path / "x.tiff", "wb") as f:
        f.write(b"nothing")
    with pytest.raises(ValueError):
        tiff.read_header(str(tmp_path / "x.tiff"))
    with pytest.raises(ValueError):
        tiff.write(str(tmp_path / "y.tiff"), 3, 1.0, CENTRE, iter([np.zeros(3)]))


def test_compute_and_viewshed(spark, hill_file, tmp_path):
    rows, settings = dem.read_dem(spark, hill_file, observer_height=0.8)
    out, store = str(tmp_path / "out"), str(tmp_path / "store")
    made = api.compute(rows, settings, output=out, segments_path=store)
    assert {r["dem_id"] for r in made.collect()} == set(POVS)
    header = tiff.read_header(f"{out}/total_surfaces.tiff")
    grid = np.array(list(tiff.read_rows(f"{out}/total_surfaces.tiff", header, 0, 4))).ravel()
    assert grid[[5, 6, 9, 10]] == pytest.approx([6.283163, 21.118624, 47.909348, 62.832096], rel=1e-5) and grid.sum() == pytest.approx(grid[[5, 6, 9, 10]].sum())
    bits = np.array(list(tiff.read_rows(f"{out}/longest_lines.tiff", tiff.read_header(f"{out}/longest_lines.tiff"), 0, 4)), "<f4").view(np.uint32).ravel()
    assert [(b >> 10, b & 1023) for b in bits[[5, 6, 9, 10]]] == [(1, 0), (4, 29), (4, 1), (4, 0)]
    assert open(f"{out}/total_surfaces.png", "rb").read(8) == b"\x89PNG\r\n\x1a\n"
    lon, lat = CENTRE
    text = json.loads(api.viewshed(spark, store, lon, lat, out))
    ring = np.array(text["features"][0]["geometry"]["coordinates"][0][0])
    assert np.abs(ring - CENTRE).max() < 1e-3
    with pytest.raises(ValueError):
        api.viewshed(spark, store, lon + 1, lat)


def test_neighbourhood_store(spark, hill_file, tmp_path):
    rows, settings = dem.read_dem(spark, hill_file, observer_height=0.8, neighbourhood=16)
    values = kernel.surfaces(rows, settings)
    from sightline.operators.aggregate import dense

    best = dense(values, settings, ["sum_k"]).withColumnRenamed("sum_k", "value")
    store, better = str(tmp_path / "store"), str(tmp_path / "better")
    assert api.compute(rows, settings, process="viewsheds", segments_path=store, best_source=best) is None
    kept = spark.read.parquet(f"{store}/polar_segments")
    assert {(r[0], r[1]) for r in kept.select("dem_id", "neighbourhood_id").distinct().collect()} == {(78, 4)}
    sinks.optimise_layout(spark, store, better)
    assert spark.read.parquet(f"{better}/polar_segments").exceptAll(kept).isEmpty()
    assert json.loads(api.viewshed(spark, better, *CENTRE))["features"]
    with pytest.raises(ValueError):
        api.compute(rows, settings, segments_path=store)


def test_databases_there_and_back(spark, hill_file, tmp_path):
    rows, settings = dem.read_dem(spark, hill_file, observer_height=0.8)
    stored = segments.stored(kernel.segments(rows, settings)).cache()
    sinks.export_sqlite(stored, settings, str(tmp_path / "db"), shards=3)
    back, meta = sinks.import_sqlite(spark, str(tmp_path / "db"))
    assert back.exceptAll(stored).isEmpty() and stored.exceptAll(back).isEmpty()
    assert settings_of(meta, observer_height=0.8) == Settings(12, observer_height=0.8, centre=CENTRE)


def test_png_bytes(tmp_path):
    path = str(tmp_path / "a.png")
    sinks.write_png(path, 2, 2, iter([np.array([0, 255]), np.array([7, 8])]))
    data = open(path, "rb").read()
    assert struct.unpack(">II", data[16:24]) == (2, 2)
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]) == b"\0\x00\xff\0\x07\x08"
    with pytest.raises(ValueError):
        sinks.write_png(path, 2, 2, iter([np.array([1, 2])]))


def made_tiff(path, values, order="<", big=False, packing=1, predictor=1, tile=None, strip=None, kind=np.int16):
    """A raster file of another make than `tiff.write`: any byte order, tiled or in strips, packed."""
    values = np.asarray(values).astype(np.dtype(kind).newbyteorder(order))
    size = values.dtype.itemsize
    n = len(values)

    def packed(block):
        if predictor == 2:
            whole = block.astype(block.dtype.newbyteorder("=")).view(f"u{size}")
            block = np.diff(whole, axis=1, prepend=whole[:, :1] * 0).astype(np.dtype(f"u{size}").newbyteorder(order))
            raw = block.tobytes()
        elif predictor == 3:
            planes = block.astype(">f4").view(np.uint8).reshape(*block.shape, 4).transpose(0, 2, 1).reshape(len(block), -1)
            raw = np.diff(planes, axis=1, prepend=planes[:, :1] * 0).astype(np.uint8).tobytes()
        else:
            raw = block.tobytes()
        if packing in (8, 32946):
            return zlib.compress(raw)
        if packing == 5:
            return lzw(raw)
        if packing == 32773:
            runs = [(k, len(list(g))) for k, g in itertools.groupby(raw)]
            return b"".join(bytes([257 - m, k]) if m > 1 else bytes([0, k]) for k, n in runs for m in [128] * (n // 128) + [n % 128] * (n % 128 > 0))
        return raw

    if tile:
        blocks = [np.pad(values, ((0, -n % tile), (0, -n % tile)))[r : r + tile, c : c + tile] for r in range(0, n, tile) for c in range(0, n, tile)]
    else:
        blocks = [values[r : r + (strip or n)] for r in range(0, n, strip or n)]
    raws = [packed(b) for b in blocks]
    word, entry = ("Q", "HHQ") if big else ("I", "HHI")
    room = struct.calcsize(word)
    at = 16 if big else 8
    data, offsets = b"", []
    for raw in raws:
        offsets.append(at + len(data))
        data += raw
    data += b"\0" * (len(data) % 2)
    projection = b"+proj=aeqd +lat_0=33.33 +lon_0=33.33|\0"
    kind_of = next(k for k, v in tiff.KINDS.items() if v == kind)
    tags = {
        256: (4, (n,)), 257: (4, (n,)), 258: (3, (kind_of[1],)), 259: (3, (packing,)), 277: (3, (1,)), 317: (3, (predictor,)), 339: (3, (kind_of[0],)),
        33550: (12, (1.0, 1.0, 0.0)), 33922: (12, (0.0, 0.0, 0.0, -n / 2, n / 2, 0.0)), 34737: (2, projection),
        **({322: (4, (tile,)), 323: (4, (tile,)), 324: (16 if big else 4, tuple(offsets)), 325: (4, tuple(map(len, raws)))} if tile else {273: (4, tuple(offsets)), 278: (4, (strip or n,)), 279: (4, tuple(map(len, raws)))}),
    }
    out, later = b"", b""
    first = at + len(data)
    beyond = first + (8 if big else 2) + (20 if big else 12) * len(tags) + room
    for tag, (t, v) in sorted(tags.items()):
        raw = v if t == 2 else struct.pack(f"{order}{len(v)}{tiff.SIZES[t]}", *v)
        out += struct.pack(order + entry, tag, t, len(v))
        if len(raw) <= room:
            out += raw.ljust(room, b"\0")
        else:
            out += struct.pack(order + word, beyond + len(later))
            later += raw + b"\0" * (len(raw) % 2)
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, first) if big else struct.pack(order + "HI", 42, first))
    with open(path, "wb") as f:
        f.write(head + data + struct.pack(order + ("Q" if big else "H"), len(tags)) + out + struct.pack(order + word, 0) + later)


def lzw(raw):
    """A packer for `tiff.unpack_lzw`, which grows its codes one entry early and starts anew when the table is full."""
    bits, held = "", b""
    table, width = {bytes([i]): i for i in range(256)}, 9
    bits += format(256, "09b")
    n = 258
    for byte in raw:
        byte = bytes([byte])
        if held + byte in table:
            held += byte
            continue
        bits += format(table[held], f"0{width}b")
        table[held + byte] = n
        n += 1
        width = min(12, n.bit_length())
        if n == 4094:
            bits += format(256, f"0{width}b")
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        held = byte
    if held:
        bits += format(table[held], f"0{width}b")
        n += 1
        width = min(12, n.bit_length())
    bits += format(257, f"0{width}b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize(
    "how",
    [
        {}, {"strip": 5}, {"tile": 16}, {"packing": 8}, {"packing": 8, "predictor": 2, "strip": 7}, {"packing": 32946, "tile": 16, "predictor": 2}, {"packing": 5, "strip": 10}, {"packing": 5, "predictor": 2, "tile": 32},
        {"packing": 32773, "strip": 4}, {"packing": 8, "predictor": 3, "kind": np.float32}, {"kind": np.uint16, "tile": 16, "packing": 8},
    ],
)
def test_rasters_of_all_makes(tmp_path, order, big, how):
    draw = np.random.default_rng(5)
    values = np.cumsum(draw.integers(-3, 4, (45, 45)), axis=1) + 100
    path = str(tmp_path / "a.tiff")
    made_tiff(path, values, order, big, **how)
    header = tiff.read_header(path)
    assert header.lonlat() == CENTRE and header.scale == 1.0
    for start, stop in ((0, 45), (7, 23), (44, 45)):
        assert np.array_equal(np.array(list(tiff.read_rows(path, header, start, stop))), values[start:stop])


def test_lzw_of_long_texts():
    draw = np.random.default_rng(1)
    for raw in (b"", b"a", b"abababababab" * 50, bytes(draw.integers(0, 4, 60_000).astype(np.uint8)), bytes(draw.integers(0, 256, 30_000).astype(np.uint8))):
        assert tiff.unpack_lzw(lzw(raw)) == raw


def test_packed_tiles_as_elevations(spark, tmp_path):
    path = str(tmp_path / "hill.tiff")
    made_tiff(path, np.array(HILL).reshape(12, 12), packing=8, predictor=2, tile=16)
    rows, settings = dem.read_dem(spark, path)
    assert [r["elev"] for r in rows.orderBy("dem_id").collect()] == HILL and settings.centre == CENTRE
    heat = dem.read_heatmap(spark, path)
    assert [r["value"] for r in heat.orderBy("tvs_id").collect()] == HILL


def test_large_files_are_written_as_big_tiff(tmp_path, monkeypatch):
    monkeypatch.setattr(tiff, "CLASSIC_BYTES", 100)
    path = str(tmp_path / "big.tiff")
    tiff.write(path, 12, 30.0, CENTRE, iter(np.array(HILL).reshape(12, 12)), np.int16)
    assert open(path, "rb").read(4) == b"II\x2b\0"
    header = tiff.read_header(path)
    assert np.array(list(tiff.read_rows(path, header, 0, 12))).ravel().tolist() == HILL and header.lonlat() == CENTRE and header.scale == 30.0
