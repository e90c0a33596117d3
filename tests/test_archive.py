"""Archives written as streams: read by the standard reader, wide forms included, and never held."""

import io
import json
import random
import tracemalloc
import zipfile
import zlib

from evalspark.sources import archive


def test_wide_directories_are_read(monkeypatch):
    """Counts and offsets beyond the narrow form, by lowering where it ends."""
    for wide, count in ((archive.WIDE, archive.WIDE_COUNT), (archive.WIDE, 3), (100, 0xFFFF)):
        out = io.BytesIO()
        made = archive._Zip(out)
        many = 70_000 if wide > 100 and count > 3 else 9
        for i in range(many):
            data = f"image {i} é".encode()
            deflate = zlib.compressobj(wbits=-15)
            made.add(f"é{i}.png", zlib.crc32(data), len(data), deflate.compress(data) + deflate.flush())
        made.close()
        held = zipfile.ZipFile(io.BytesIO(out.getvalue()))
        assert len(held.namelist()) == many and held.read(f"é{many - 1}.png") == f"image {many - 1} é".encode()
        if many < 10:
            assert held.testzip() is None


def test_an_archive_larger_than_what_is_held(tmp_path):
    """400 MB pass through with a few MB in memory."""
    data = random.Random(1).randbytes(1 << 20)
    tracemalloc.start()
    run = archive._Run("r", '{"a": 1}', str(tmp_path))
    for i in range(400):
        run.add(f"i{i:03d}", True, None, f"i{i:03d}.png", zlib.crc32(data), len(data), data)  # whatever bytes: nobody unpacks them here
    done = run.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done[:5] == ("r", 400, 0, 0, 400) and peak < 16 << 20
    assert (tmp_path / "r" / "passing_images.zip").stat().st_size > 400 << 20
    assert len(json.loads((tmp_path / "r" / "eval_report.json").read_text())) == 400 and json.loads((tmp_path / "r" / "reject_archive.json").read_text()) == []
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["eval_report.json", "manifest.json", "passing_images.zip", "reject_archive.json"]
