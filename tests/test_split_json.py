"""Documents read in byte ranges, against a whole parse."""

from __future__ import annotations

import json
import random

import pytest

from thriftline import schemas
from thriftline.sources import documents, split_json


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "\n", "a", "\\\\", '\\"']) for _ in range(rng.randint(0, 12)))


def document(rng, records):
    value = {
        "a{": odd_text(rng), "list": [odd_text(rng) for _ in range(3)], odd_text(rng) + "k": {"x": {"y": [{"z": 1}]}},
        "functions": [{"id": odd_text(rng), "sub": {"l": [{"q": odd_text(rng)}, []]}} for _ in range(records)], "empty": [], "n": 1.5, "last": [{}],
    }
    return json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])).encode()


def cut_up(data, size):
    """Frame and records from ranges, without Spark."""
    ranges = [data[i : i + size] for i in range(0, len(data), size)]
    way, depth, frame, records, lists = 0, 0, b"", [], 0
    for n, part in enumerate(ranges):
        kept, inside, found = split_json.cut("here", n * size, part, way, depth, ahead=7)
        frame += kept
        records += [(lists + before, place, text) for before, place, text in found]
        lists += inside
        way, deeper = split_json.summed_up(part)[way]
        depth += deeper
    assert (way, depth) == (0, 0)
    return json.loads(frame), records


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_ranges_equal_a_whole_parse(monkeypatch, size):
    rng = random.Random(size)
    for _ in range(25):
        data = document(rng, rng.randint(0, 6))
        monkeypatch.setattr(split_json, "_read", lambda uri, start, n: data[start : start + n])
        frame, records = cut_up(data, size)
        whole = json.loads(data)
        names = [k for k, v in whole.items() if isinstance(v, (list, dict))]
        assert list(frame) == list(whole) and frame["a{"] == whole["a{"] and frame["n"] == 1.5 and frame["functions"] == []
        in_list = [(names[nth - 1], json.loads(text)) for nth, _, text in records]
        assert [r for name, r in in_list if name == "functions"] == whole["functions"]
        assert [r for name, r in in_list if name == "last"] == [{}]


def test_same_rows_as_the_whole_reader(spark, tmp_path):
    rng = random.Random(1)
    for n in range(3):
        functions = [
            {"id": f"{n}.{i}", "name": odd_text(rng), "function_code": odd_text(rng) * 9, "baseline_emissions_kg": rng.choice([None, i / 3])}
            for i in range(n * 40)
        ]
        whole = {"project_root": odd_text(rng), "generated_at": "now", "other": [{"id": "no"}], "functions": functions}
        (tmp_path / f"d{n}.json").write_text(json.dumps(whole, indent=n or None))
    wanted = documents.read_documents(spark, str(tmp_path), schemas.RESULT_DOCUMENT)
    got = split_json.read_split_documents(spark, str(tmp_path), schemas.RESULT_DOCUMENT, size=512)
    assert got.columns == wanted.columns and got.count() == 120
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


@pytest.mark.parametrize("text", ["[1]", '{"functions": [', '{"a": "', '{"functions": [{"id": 1]}'])
def test_broken_files_are_errors(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        split_json.read_split_documents(spark, str(tmp_path), schemas.RESULT_DOCUMENT).collect()
