"""Packages, combination, generation, files."""

from __future__ import annotations

import json
import zipfile

import pytest
from loamworks.operators.pairs import training_instruction
from loamworks.plans import extract as ex
from loamworks.plans import pipelines as pl
from loamworks.sources import files, sinks, text_files
from loamworks.sources import zip_datasets as zd


def package(path, **entries):
    return sinks.write_zip(str(path), {k.replace("__", "/") + ".jsonl": v for k, v in entries.items()})


def rows(*pairs, **more):
    return "".join(json.dumps({"instruction": i, "output": o, **more}) + "\n" for i, o in pairs)


def texts(df):
    return {(r["instruction"], r["output"], r["split"]) for r in df.collect()}


def test_read_dataset_coercion(tmp_path):
    lines = '{"instruction":" a ","output":7,"source":null,"chunk":"3"}\n\n{"instruction":"b","output":true,"chunk":"x"}\n{"instruction":"","output":"gone"}\n{"instruction":[1,"z"],"output":{"k":1}}\n5\n'
    path = package(tmp_path / "one.v2.zip", alpaca=lines, chunks='{"id":4,"text":" t ","approx_tokens":9}\n{"text":null}\n')
    got = zd.read_dataset(path, 0)
    assert [g[5:9] for g in got if g[0] == "pair"] == [("a", "7", "one.v2", 3), ("b", "true", "one.v2", None), ("1,z", "[object Object]", "one.v2", 0)]
    assert [g[7:11] for g in got if g[0] == "chunk"] == [("one.v2", 4, " t ", 9), ("one.v2", 0, "", 0)]


@pytest.mark.parametrize("bad", ["{'a': 1}\n", '{"a": NaN}\n', '{"a":1} junk\n', "null\n", "\ufeff{}\n"])
def test_broken_lines_skip_the_file(tmp_path, bad):
    path = package(tmp_path / "b.zip", alpaca=rows(("q", "a")), chunks=bad)
    assert [r[0] for r in zd.read_dataset(path, 0)] == ["skipped"]


def test_combine(spark, tmp_path):
    a = package(tmp_path / "a.zip", alpaca=rows(("What?", "This."), ("C++", "x"), source="S", chunk=1), chunks='{"text":"One two","source":"S"}\n{"text":"one, TWO!"}\n')
    b = package(tmp_path / "b.zip", alpaca__train=rows(("what", "this"), ("new", "pair"), source="T"), alpaca__validation=rows(("C", "X"), source="T"))
    none = package(tmp_path / "none.zip", other="{}\n")
    broken = tmp_path / "broken.zip"
    broken.write_bytes(b"no zip")
    both = pl.combine(spark, [a, b, none, str(broken)])
    s = both.summary()
    assert s["files"] == 2 and s["pairs"] == 3 and s["duplicates_removed"] == 2 and s["train"] + s["validation"] == 3
    assert s["sources"] == [{"source": "S", "pairs": 2}, {"source": "T", "pairs": 1}]
    assert [x["file"] for x in s["skipped_files"]] == ["none.zip", "broken.zip"] and s["skipped_files"][1]["reason"] == zd.NOT_A_ZIP
    assert [r["text"] for r in both.chunks.collect()] == ["One two"]
    out = both.save(str(tmp_path / "combined_dataset.zip"))
    with zipfile.ZipFile(out) as z:
        assert set(z.namelist()) == {"alpaca/train.jsonl", "alpaca/validation.jsonl", "chat/train.jsonl", "chat/validation.jsonl", "chunks.jsonl", "stats.json"}
        kept = [json.loads(x) for n in ("train", "validation") for x in z.read(f"alpaca/{n}.jsonl").decode().splitlines()]
        assert {k["instruction"] for k in kept} == {"What?", "C++", "new"} and all(k["input"] == "" for k in kept)
        chat = json.loads(z.read("chat/train.jsonl").decode().splitlines()[0])
        assert [m["role"] for m in chat["messages"]] == ["user", "assistant"]
    assert texts(pl.combine(spark, [out, b]).pairs) == texts(both.pairs)  # a combined package is valid input, splits stay
    twice = pl.combine(spark, [a, a]).summary()
    assert twice["duplicates_removed"] == 0 and twice["files"] == 1  # a path counts once
    assert pl.combine(spark, [a, b], without=[b]).summary()["sources"] == [{"source": "S", "pairs": 2}]
    with pytest.raises(ValueError, match="x.pdf"):
        pl.combine(spark, [a, "/x.pdf"])
    big = str(tmp_path / "folder")
    sinks.write_folder(both.pairs, both.chunks, big)
    found = {n: sorted(r["value"] for r in spark.read.text(f"{big}/{n}").collect()) for n in ("alpaca/train", "alpaca/validation", "chat/train", "chat/validation", "chunks")}
    with zipfile.ZipFile(out) as z:
        assert found == {n: sorted(z.read(f"{n}.jsonl").decode().splitlines()) for n in found}
    with pytest.raises(ValueError):
        pl.combine(spark, [none, str(broken)])


def test_generate(spark):
    docs = spark.createDataFrame([("d1", "one.\n\n" + "x" * 50 + "\n\nlast bit"), ("d2", "busy"), ("d3", "  ")], "source string, text string")
    made = pl.generate_dataset(docs, lambda: ex.OfflineExtractor(lambda p: ex.ExtractorError("m", kind="overloaded_error", status=529) if "x" in p or "busy" in p else None), most=50)
    stats = {r["source"]: r for r in made.stats.collect()}
    assert (stats["d1"]["chunks"], stats["d1"]["pairs"], stats["d1"]["skipped_chunks"], stats["d1"]["error"]) == (3, 2, [2], None)
    assert stats["d2"]["error"] == ex.MESSAGES["overloaded_error"] and stats["d3"]["chunks"] == 0 and stats["d3"]["error"]
    told = {r["source"]: r["warning"] for r in made.warnings.collect()}
    assert set(told) == {"d1", "d2"} and told["d1"].endswith(ex.MESSAGES["overloaded_error"])
    assert all(r["instruction"] == r["instruction"].strip() for r in made.pairs.collect())


def test_progress_and_save(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "one.\n\ntwo."), ("d2", "tres.")], "source string, text string")
    done = spark.sparkContext.accumulator(0)
    made = pl.generate_dataset(docs, ex.OfflineExtractor, most=5, progress=done)
    assert done.value == 3
    path = pl.save(made, str(tmp_path / "one.zip"), "ai-data", source="d1")
    with zipfile.ZipFile(path) as z:
        assert set(z.namelist()) == {"alpaca.jsonl", "chat.jsonl", "chunks.jsonl", "stats.json"}
        stats = json.loads(z.read("stats.json"))
        assert list(stats) == ["source", "model", "created_at", "chunks", "pairs", "approx_source_tokens", "approx_dataset_tokens", "skipped_chunks"]
        assert (stats["source"], stats["chunks"], stats["pairs"]) == ("d1", 2, 2) == (stats["source"], len(z.read("chunks.jsonl").splitlines()), len(z.read("alpaca.jsonl").splitlines()))
    both = pl.combine(spark, [path, pl.save(made, str(tmp_path / "two.zip"), "ai-data", source="d2")])
    assert zipfile.is_zipfile(pl.save(both, str(tmp_path / "both.zip"), "combined")) and both.summary()["pairs"] == 3
    result = pl.extract_structured(docs, "analytics", ex.OfflineExtractor)
    with zipfile.ZipFile(pl.save(result, str(tmp_path / "three.zip"), "analytics", source="d2")) as z:
        entry = json.loads(z.read("training.jsonl"))
        assert entry["input"] == "tres." and json.loads(entry["output"]) == json.loads(z.read("output.json"))
        assert entry["instruction"] == training_instruction("analytics")
    with pytest.raises(ValueError):
        pl.save(pl.extract_structured(docs.selectExpr("source", "' ' AS text"), "analytics", ex.OfflineExtractor), str(tmp_path / "no.zip"), "analytics")


def test_service(monkeypatch):
    monkeypatch.setenv("LOAMWORKS_API_KEY", "k")
    monkeypatch.setenv("LOAMWORKS_MODEL", "m")
    settings, waits = ex.Settings.from_environment(), []

    def service(*answers, **more):
        held, seen = list(answers), []

        def send(request, key, timeout):
            seen.append((request, key, timeout))
            if isinstance(answer := held.pop(0), Exception):
                raise answer
            return answer

        return ex.ServiceExtractor(settings, send, sleep=waits.append, **more), seen

    def reply(text="", stop="end_turn"):
        return {"stop_reason": stop, "content": [{"type": "thinking", "text": "?"}, {"type": "text", "text": text}, {"type": "text", "text": "!"}]}

    def busy(status=None):
        return ex.ExtractorError("busy", kind="timeout" if status is None else "other", status=status)

    one, seen = service(busy(), busy(429), busy(529), reply("ok"))
    assert one.complete("p", {"type": "object"}) == "ok!" and waits == [0.5, 1.0, 2.0]
    request, key, timeout = seen[-1]
    assert (request["model"], request["max_tokens"], key, timeout) == ("m", 16_000, "k", 120) and request["output_config"]["format"]["schema"] == {"type": "object"}
    for errors, calls in (([busy(500)] * 9, 5), ([busy(401)] * 9, 1)):
        one, seen = service(*errors)
        with pytest.raises(ex.ExtractorError):
            one.complete("p")
        assert len(seen) == calls and "output_config" not in seen[0][0]
    for stop in ("refusal", "max_tokens"):
        with pytest.raises(ex.ExtractorError) as e:
            service(reply("x", stop))[0].complete("p")
        assert ex.describe(e.value) == ex.MESSAGES[stop] and not ex.stops_all(e.value)
    monkeypatch.delenv("LOAMWORKS_API_KEY")
    with pytest.raises(ValueError):
        ex.Settings.from_environment()


def test_stop_rule(spark):
    docs = spark.createDataFrame([("d", "\n\n".join("abcdefgh"))], "source string, text string")
    seen = pl.generate_dataset(docs, lambda: ex.OfflineExtractor(lambda p: ex.ExtractorError("limit", status=429) if p == "c" else None), most=1, concurrency=1, tasks=1).outcomes
    status = [r["status"] for r in seen.collect()]
    assert status.count("failed") == 1 and set(status) <= {"ok", "failed", "not_attempted"}
    assert ex.stops_all(ex.ExtractorError("x")) and not ex.stops_all(ex.ExtractorError("x", status=500)) and not ex.stops_all(ValueError("x"))


def test_structured(spark):
    docs = spark.createDataFrame([("a", "text"), ("b", " \n")], "source string, text string")
    got = {r["source"]: r for r in pl.extract_structured(docs, "analytics", ex.OfflineExtractor).collect()}
    assert got["a"]["status"] == "ok" and json.loads(got["a"]["reply"])["digest"] and got["b"]["status"] == "failed"
    with pytest.raises(ValueError, match="Unknown output type"):
        pl.extract_structured(docs, "other", ex.OfflineExtractor)


def test_ask_for_json():
    class Flaky:
        def __init__(self, *replies):
            self.replies = list(replies)

        def complete(self, prompt, schema=None):
            return self.replies.pop(0)

    assert ex.ask_for_json(Flaky("no", "```json\n[1]\n```"), "p") == [1]
    with pytest.raises(ex.ExtractorError):
        ex.ask_for_json(Flaky("no", "{'a':1}", "NaN", "{}"), "p")
    assert ex.pairs_of({"pairs": [{"instruction": " a ", "output": "b"}, {"instruction": " ", "output": "c"}]}) == [{"instruction": "a", "output": "b"}]


def test_names_and_entries():
    assert sinks.output_name("a.b.PDF", "analytics") == "a.b_analytics.zip" and sinks.output_name("x.txt", "ai-data") == "x.txt_ai-data.zip" and sinks.output_name("", "combined") == "combined_dataset.zip"
    entries = sinks.document_entries({"a": [1, None]}, "whole", "do")
    assert entries["output.json"].startswith('{\n  "a"') and not entries["training.jsonl"].endswith("\n")
    assert files.stem("/x/a.b.zip") == "a.b" and files.stem(".zip") == ".zip"


def test_text_files(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.DOCX", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r["source"]: r for r in text_files.extract_text(spark, str(tmp_path), {".pdf": lambda b: "pdf text"}).collect()}
    assert got["a.DOCX"]["text"] == "One\ttwo\n\nThree\n\n" and got["b.txt"]["error"] == "Unsupported file type: .txt" and got["c.pdf"]["text"] == "pdf text"


def test_streams(spark, tmp_path):
    from loamworks.streaming.chunks import chunk_stream, combine_stream

    spark.createDataFrame([("a", "one\n\ntwo")], "source string, text string").write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema("source string, text string").parquet(str(tmp_path / "docs"))
    q = chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "c1"), 3)
    q.processAllAvailable()
    q.stop()
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"one", "two"}
    schema = "instruction string, output string, source string, chunk int"
    for k, pairs in enumerate([[("a", "b", "s", 1), ("A!", "b", "t", 1)], [("a", "B", "u", 2), ("c", "d", "u", 3)]]):
        spark.createDataFrame(pairs, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pairs"))
        q = combine_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "pairs")), str(tmp_path / "unique"), str(tmp_path / "c2"))
        q.processAllAvailable()
        q.stop()
        got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "unique"))
        assert got.count() == k + 1 and got.where("source = 's'").count() == 1
