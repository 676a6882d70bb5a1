from __future__ import annotations

import json
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from plumbline.__main__ import main
from plumbline.sources import providers


def test_eval_formats_and_codes(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("ok\nmail joe@gmail.com")
    (tmp_path / "b.md").write_text("nothing here")
    every, clean = str(tmp_path / "*.md"), str(tmp_path / "b.md")
    assert main(["eval", every, "--preset", "safety"], spark) == 1
    out = capsys.readouterr().out
    assert "FAIL" in out and "PASS" in out and "joe" not in out
    assert main(["eval", every, "--format", "annotations"], spark) == 1
    assert capsys.readouterr().out.startswith("::error file=")
    target = tmp_path / "out.json"
    assert main(["eval", clean, "--format", "json", "--output", str(target)], spark) == 0
    rows = json.loads(capsys.readouterr().out)
    assert rows == json.loads(target.read_text()) and len(rows) == 1
    assert rows[0]["passed"] and rows[0]["preset_name"] == "quality" and rows[0]["redactions_count"] == 0
    assert main(["eval", every, "--dry-run", "--format", "markdown"], spark) == 0
    assert "| `" in capsys.readouterr().out
    assert main(["eval", every, "--no-fail"], spark) == 0
    capsys.readouterr()
    assert main(["eval", every, "--exclude", "*.md", "--format", "json"], spark) == 0 and capsys.readouterr().out.strip() == "[]"
    assert main(["eval", str(tmp_path / "*.txt")], spark) == 0 and "No matching files." in capsys.readouterr().out
    assert main(["eval", str(tmp_path / "gone.md")], spark) == 2
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe broken")
    assert main(["eval", every], spark) == 1 and "not valid UTF-8" in capsys.readouterr().err
    assert main(["eval", str(tmp_path / "b*.md")], spark) == 3
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "c.md").write_text("x")
    capsys.readouterr()
    assert main(["eval", str(tmp_path / "build" / "c.md"), str(tmp_path / "*" / "c.md"), str(tmp_path / "build" / "*.md")], spark) == 0
    assert capsys.readouterr().out.count("PASS") == 1  # a file that is named, or below the folder where wildcards begin, is read


def test_changed_files(spark, tmp_path, capsys, monkeypatch):
    git = lambda *a: subprocess.run(
        ["git", "-c", "user.name=x", "-c", "user.email=x@x", "-C", str(tmp_path), *a], check=True, capture_output=True
    )
    git("init", "-q")
    (tmp_path / "old.md").write_text("old")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "new.md").write_text("new")
    (tmp_path / "new.bin").write_text("new")
    git("add", ".")
    monkeypatch.chdir(tmp_path)
    assert main(["eval", "--staged", "--format", "json"], spark) == 0
    assert [r["filename"] for r in json.loads(capsys.readouterr().out)] == ["new.md"]
    git("commit", "-qm", "two")
    assert main(["eval", "--since", "HEAD~1", str(tmp_path / "*.md"), "--format", "json"], spark) == 0
    assert [r["filename"] for r in json.loads(capsys.readouterr().out)] == ["new.md"]


def test_other_commands(spark, tmp_path, capsys):
    assert main(["presets"], spark) == 0
    assert capsys.readouterr().out.split() == ["design_doc", "pr_description", "quality", "safety", "tech-spec"]
    assert main(["schema"], spark) == 0 and "questions" in json.loads(capsys.readouterr().out)["properties"]
    assert main(["schema", "labels"], spark) == 0
    labels = json.loads(capsys.readouterr().out)
    assert labels["additionalProperties"] is False and labels["properties"]["criteria"]["properties"]["min_detected"] == {"type": "number"}
    own = tmp_path / "p.yaml"
    own.write_text("name: own\nquestions:\n  a: {type: noul}\n")
    assert main(["check-preset", str(own)], spark) == 0 and capsys.readouterr().out == "a (noul)\n"
    assert main(["clear-cache", "--cache-dir", str(tmp_path / "none")], spark) == 0 and "0 results" in capsys.readouterr().out


class Service(BaseHTTPRequestHandler):
    """Answers as a list, or as a mapping where the document says so; fails once where it says so."""

    seen: list = []
    failed: set = set()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = body["input"] if isinstance(body["input"], str) else body["input"][0]["text"]
        Service.seen.append(body)
        if self.headers["Authorization"] != "Bearer key":
            return self.reply(401, {})
        if "flaky" in text and text not in Service.failed:
            Service.failed.add(text)
            return self.reply(503, {})
        worse = 0.3 if "worse" in text else 0.9
        given = {
            "predicate": {"probability": 0.05 if "absent" in text else worse}, "score": {"score": 2 * worse, "confidence": 0.8},
            "choice": {"choice": "professional"}
        }
        answers = [{"name": q["name"], **given[q["type"]]} for q in body["questions"]]
        if "mapping" in text:
            return self.reply(200, {"decisions": {a.pop("name"): a for a in answers}, "usage": {"prompt_tokens": 7, "completion_tokens": 2}})
        return self.reply(200, {"answers": answers, "model": "m1", "usage": {"input_tokens": 10, "output_tokens": 5}})

    def reply(self, code, body):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def service(monkeypatch):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("PLUMBLINE_API_KEY", "key")
    Service.seen, Service.failed = [], set()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_provider_over_http(spark, tmp_path, capsys, service):
    (tmp_path / "a.md").write_text("fine flaky ![p](p.png)")
    (tmp_path / "b.md").write_text("worse mapping")
    (tmp_path / "p.png").write_bytes(b"12")
    every = str(tmp_path / "*.md")
    options = ["--preset", "quality", "--provider", "http", "--url", service, "--format", "json", "--cache", "--cache-dir", str(tmp_path / "cache")]
    assert main(["eval", every, "--images", *options], spark) == 0
    rows = {r["filename"]: r for r in json.loads(capsys.readouterr().out)}
    a, b = rows["a.md"], rows["b.md"]
    assert a["answers"] == {"clarity": 0.9} and a["choices"] == {"tone": "professional"} and (
        a["input_tokens"], a["output_tokens"], a["model"]
    ) == (10, 5, "m1")
    assert b["warnings"] == ["Clarity & Structure: score 0.30 is below minimum 0.60 (warning)"] and b["input_tokens"] == 7 and b["passed"]
    assert any(isinstance(x["input"], list) and x["input"][1]["image_url"] == "data:image/png;base64,MTI=" for x in Service.seen)
    levels = next(q for q in Service.seen[0]["questions"] if q["type"] == "score")["levels"]
    assert levels == [{"label": "0", "description": "confusing"}, {"label": "1", "description": "readable"}, {"label": "2", "description": "crisp"}]
    asked = len(Service.seen)
    assert main(["eval", every, "--images", *options], spark) == 0 and len(Service.seen) == asked
    assert all(r["cached"] for r in json.loads(capsys.readouterr().out))
    assert main(["clear-cache", "--cache-dir", str(tmp_path / "cache")], spark) == 0 and "2 results" in capsys.readouterr().out
    with pytest.raises(PermissionError):
        providers.HttpProvider(service, "wrong").decide({"document": "x"}, {"q": {"type": "noul"}})
    with pytest.raises(PermissionError):
        providers.HttpProvider(service).decide({"document": "x"}, {"q": {"type": "noul"}})
    with pytest.raises(RuntimeError, match="connection"):
        providers.HttpProvider("http://127.0.0.1:1", "key").decide({"document": "x"}, {"q": {"type": "noul"}})
    for bad in ("nothing", "auto"):
        with pytest.raises(ValueError):
            providers.provider(bad)


def test_baseline_and_project_file(spark, tmp_path, capsys, service, monkeypatch):
    doc, report = tmp_path / "a.md", tmp_path / "before.json"
    doc.write_text("fine")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".plumbline.yaml").write_text("preset: tech-spec\nquestions:\n  own: {type: noul, max_threshold: 0.95, label: Own}\n")
    monkeypatch.chdir(tmp_path)
    online = ["--provider", "http", "--url", service, "--format", "json"]
    assert main(["eval", str(doc), *online, "--output", str(report)], spark) == 0
    assert json.loads(report.read_text())[0]["answers"] == {"has_test_plan": 0.9, "own": 0.9}
    doc.write_text("absent")
    capsys.readouterr()
    assert main(["eval", "a.md", *online, "--baseline", str(report)], spark) == 1
    row = json.loads(capsys.readouterr().out)[0]
    assert any(v.startswith("Baseline drop: 'has_test_plan' dropped by 0.85") for v in row["violations"])
    assert row["baseline"]["status"] == "compared" and {
        q["question_id"]: q["regressed"] for q in row["baseline"]["questions"]
    } == {"has_test_plan": True, "own": False}
    assert main(["eval", "a.md", *online, "--preset", "quality", "--baseline", str(report)], spark) == 2


LABELS = """
preset: tech-spec
runs: 2
criteria: {min_detected: 1.0, max_false_alarms: 0, max_spread: 0.1, pair_guard_neutral_abs_max: 0.05, min_degradation_drop: 0.2}
documents:
- {path: absent.md, expect: {has_test_plan: absent}}
- {path: good.md, expect: {has_test_plan: present}}
pairs:
- {before: good.md, after: worse.md, expect: {has_test_plan: down}, kind: padded}
"""


def test_validate(spark, tmp_path, capsys, service):
    for name in ("absent", "good", "worse"):
        (tmp_path / f"{name}.md").write_text(f"{name} text")
    labels = tmp_path / "labels.yaml"
    labels.write_text(LABELS)
    online = ["--provider", "http", "--url", service]
    assert main(["validate", str(labels), *online, "--format", "json"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["all_passed"] and out["summary"]["detection_rate"] == 1.0 and len(out["criteria_results"]) == 5
    assert [(p["n"], round(p["mean_delta"], 6)) for p in out["pair_results"]] == [(2, -0.6)]
    assert out["choice_distributions"] and len(Service.seen) == 6  # three files, two runs
    assert main(["validate", str(labels), *online, "--format", "markdown"], spark) == 0
    text = capsys.readouterr().out
    assert "## Pair Groups" in text and "| good.md → worse.md | has_test_plan | down | -0.600 |" in text and "**Verdict:** PASS" in text
    labels.write_text(
        LABELS.replace("min_degradation_drop: 0.2", "min_degradation_drop: 0.7").replace(
            "good.md, expect: {has_test_plan: present", "gone.md, expect: {has_test_plan: present"
        )
    )
    assert main(["validate", str(labels), *online, "--format", "table"], spark) == 1
    shown = capsys.readouterr()
    assert "FAIL" in shown.out and "gone.md: no such file" in shown.err
    assert main(["validate", str(labels), "--dry-run", "--runs", "1"], spark) == 3 and "N/A (MOCK)" in capsys.readouterr().out
    assert main(["validate", str(labels)], spark) == 2
    labels.write_text("preset: tech-spec\ndocuments:\n- {path: good.md, expect: {readiness: present}}\n")
    assert main(["validate", str(labels), *online], spark) == 2


def test_hook_and_set_up(spark, tmp_path, capsys, monkeypatch):
    import io

    from plumbline.sources import hooks

    (tmp_path / "a.md").write_text("mail joe@gmail.com")
    (tmp_path / "b.markdown").write_text("fine")
    (tmp_path / "c.txt").write_text("x")
    folder = str(tmp_path)
    assert hooks.handed(json.dumps({"tool_input": {"file_path": "a.md"}}), folder) == ["a.md"]
    assert hooks.handed(json.dumps({"path": "gone.md", "file": "b.markdown"}), folder) == ["b.markdown"]
    assert hooks.handed("'a.md'\nc.txt\na.md\nb.markdown", folder) == ["a.md", "b.markdown"] and hooks.handed("", folder) == []
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", "-C", folder, *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.md")
    git("commit", "-qm", "one")
    assert hooks.touched(folder) == ["b.markdown"]
    (tmp_path / "a.md").write_text("mail amy@gmail.com")
    assert hooks.files([], "", folder) == ["a.md", "b.markdown"] and hooks.files(["x"], "", folder) == ["x"]
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"tool_input": {"path": "a.md"}})))
    assert main(["hook"], spark) == 1 and "FAIL" in capsys.readouterr().out
    assert main(["init", "--workflow"], spark) == 0 and len(capsys.readouterr().out.split()) == 2
    assert main(["init"], spark) == 0 and capsys.readouterr().out == "nothing to write\n"
    (tmp_path / ".pre-commit-config.yaml").write_text("repos:\n  - repo: other\n")
    assert hooks.scaffold(folder) and (tmp_path / ".pre-commit-config.yaml").read_text().endswith("  - repo: other\n")
