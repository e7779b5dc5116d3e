from paperloom.sources.texts import packed, read_texts


def test_names_bytes_and_folders(spark, tmp_path):
    files = {"a/x.txt": b"one\r\n", "b/x.txt": b"two", "top.v1.txt": "é�".encode() + b"\xff\xc3", "empty.txt": b"", "b/no.md": b"no", "_hidden/x.txt": b"h", "a/.x.txt": b"h"}
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.doc_id: (r.path, r.size, r.text) for r in read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a/x": ("a/x.txt", 5, "one\r\n"), "b/x": ("b/x.txt", 3, "two"), "top.v1": ("top.v1.txt", 7, "é�"), "empty": ("empty.txt", 0, "")}
    (tmp_path / "none").mkdir()
    assert read_texts(spark, str(tmp_path / "none")).collect() == []


def test_partitions_by_size(spark, tmp_path):
    parts = packed([("big", 100), *[(f"s{i}", 10) for i in range(10)]], 50, 0)
    assert sorted(n for p in parts for n in p) == sorted(["big", *[f"s{i}" for i in range(10)]]) and len(parts) == 4 and ["big"] in parts
    assert max(len(p) for p in parts) <= 4 and packed([], 50) == []
    for i in range(20):
        (tmp_path / f"{i}.txt").write_text("x" * 1000)
    assert read_texts(spark, str(tmp_path), partition_bytes=1 << 20).rdd.getNumPartitions() == 6  # 20 x (1000 bytes and the cost to open)
