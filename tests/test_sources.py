import json
import sqlite3

from talkatlas.sources import readers as R
from talkatlas.sources.canonical import chunks


def write(path, *objects):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(o if isinstance(o, str) else json.dumps(o) for o in objects))


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_transcripts(spark, tmp_path):
    usage = {"input_tokens": 100, "output_tokens": 20, "cache_creation_input_tokens": 7, "cache_creation": {"ephemeral_1h_input_tokens": 3}}
    write(
        tmp_path / "p" / "one.jsonl",
        {"type": "user", "timestamp": "2025-01-01T00:00:00Z", "cwd": "/home/u/shop/", "message": {"role": "user", "content": "Fix the cart"}},
        {"type": "user", "isMeta": True, "timestamp": "2025-01-01T00:00:01Z", "message": {"role": "user", "content": "injected"}},
        {"type": "assistant", "timestamp": "2025-01-01T00:00:30Z", "message": {"role": "assistant", "model": "m-1", "usage": usage, "content": [
            {"type": "thinking", "thinking": "hmm"}, {"type": "text", "text": "See https://a.example/x)."},
            {"type": "tool_use", "name": "Write", "input": {"file_path": "/home/u/shop/cart.py"}}]}},
        "not json",
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": "done   well"}]}},
        {"type": "assistant", "isSidechain": True, "message": {"role": "assistant", "model": "m-2", "usage": {"input_tokens": 1, "output_tokens": 1}, "content": "side"}},
        {"type": "summary", "summary": "Cart repair"},
        {"type": "user", "timestamp": "2025-01-01T00:01:00Z", "message": {"role": "user", "content": "<task>Thanks</task>"}},
    )
    s = by_id(R.transcripts(spark, str(tmp_path)))["agent-one"]
    assert (s.title, s.repository, s.model, s.turn_count) == ("Cart repair", "shop", "m-1", 2)
    assert (s.input_tokens, s.output_tokens, s.tokens_estimated, s.duration_seconds) == (101, 21, 0, 60.0)
    first, second = s.turns
    assert first.user_message == "Fix the cart" and second.user_message == "Thanks"
    assert "`▷ Write` /home/u/shop/cart.py" in first.assistant_response and "⮑ done well" in first.assistant_response
    assert first.thinking == "hmm" and first.tools == ["Write"] and first.files == ["/home/u/shop/cart.py"]
    assert first.urls == ["https://a.example/x"]
    use = {r.model: r for r in R.transcript_usage(spark, str(tmp_path)).collect()}
    assert (use["m-1"].write, use["m-1"].write_1h, use["m-2"].input) == (7, 3, 1)


def test_event_logs(spark, tmp_path):
    def ev(kind, ts=None, **data):
        return {"type": kind, "timestamp": ts, "data": data}

    write(
        tmp_path / "s1" / "events.jsonl",
        ev("session.start", "2025-01-01T00:00:00Z", selectedModel="m-a"),
        ev("user.message", "2025-01-01T00:00:01Z", content="Build it"),
        ev("user.message", "2025-01-01T00:00:02Z", content="  "),
        ev("assistant.message", "2025-01-01T00:00:03Z", content="On it", reasoningText="plan", outputTokens=5, model="m-b", toolRequests=[{"name": "create"}]),
        ev("tool.execution_start", "2025-01-01T00:00:04Z", toolName="create", toolCallId="c1", arguments={"path": "/w/a.py"}),
        ev("tool.execution_complete", "2025-01-01T00:00:05Z", toolCallId="c1", success=True),
        ev("tool.execution_start", "2025-01-01T00:00:06Z", toolName="create", toolCallId="c2", arguments={"path": "/w/b.py"}),
        ev("tool.execution_complete", "2025-01-01T00:00:07Z", toolCallId="c2", success=False),
        ev("session.shutdown", "2025-01-01T00:00:10Z", currentModel="m-c", totalPremiumRequests=2, totalNanoAiu=1_234_567_890, modelMetrics={"m-c": {"usage": {"inputTokens": 40, "outputTokens": 9}}}),
    )
    s = by_id(R.event_logs(spark, str(tmp_path)))["cli-s1"]
    assert (s.model, s.input_tokens, s.output_tokens, s.premium_requests, s.aiu, s.duration_seconds) == ("m-c", 40, 9, 2, 1.235, 10.0)
    (turn,) = s.turns
    assert turn.user_message == "Build it" and turn.files == ["/w/a.py"] and turn.thinking == "plan" and turn.tools == ["create"]


def test_tree_export(spark, tmp_path):
    def node(parent, role, text, hidden=False):
        return {"parent": parent, "message": {"author": {"role": role}, "create_time": 1700000000.0, "metadata": {"is_visually_hidden_from_conversation": hidden}, "content": {"content_type": "text", "parts": [text]}}}

    convo = {
        "title": "T", "conversation_id": "x", "create_time": 1700000000.0, "update_time": 1700000060.0, "current_node": "d",
        "mapping": {"a": {"parent": None, "message": None}, "b": node("a", "user", "Hi"), "c": node("b", "assistant", "Hello"), "z": node("b", "assistant", "Other branch"), "h": node("c", "assistant", "secret", True), "d": node("h", "user", "Bye")},
    }
    loop = {"title": "L", "conversation_id": "y", "current_node": "q", "mapping": {"p": node("q", "assistant", "two"), "q": node("p", "user", "one")}}
    (tmp_path / "export.json").write_text(json.dumps([convo, loop]))
    got = by_id(R.tree_exports(spark, str(tmp_path)))
    assert [(t.user_message, t.assistant_response) for t in got["chat-export-x"].turns] == [("Hi", "Hello"), ("Bye", "")]
    assert got["chat-export-x"].created_at.startswith("2023-11-14T22:13:20")
    assert got["chat-export-y"].turn_count == 2


def test_flat_export(spark, tmp_path):
    talk = [{"speaker": "Human", "content": "Q", "mode": "think", "timestamp": 1700000000000}, {"speaker": "Robot", "content": "A", "mode": "standard"}, {"speaker": "narrator", "content": "x"}]
    (tmp_path / "a.json").write_text(json.dumps({"platform": "Robot", "exportDate": "2025-01-01", "url": "u", "conversation": talk}))
    (tmp_path / "b.json").write_text(json.dumps({"platform": "else", "conversation": talk}))
    (s,) = R.flat_exports(spark, str(tmp_path), "robot").collect()
    (turn,) = s.turns
    assert (turn.user_message, turn.assistant_response, turn.thinking) == ("Q", "A", "mode: think")
    assert s.tokens_estimated == 1


def test_task_folder(spark, tmp_path):
    write(tmp_path / "t1" / "api_conversation_history.json", [{"role": "user", "content": [{"type": "text", "text": "<task>Do</task>"}], "ts": 1700000000000}, {"role": "assistant", "content": "Done"}])
    write(tmp_path / "t1" / "ui_messages.json", [{"say": "api_req_started", "text": json.dumps({"tokensIn": "12", "tokensOut": 3, "cost": 0.5})}, {"say": "text", "text": "{}"}])
    (s,) = R.task_folders(spark, str(tmp_path)).collect()
    assert (s.title, s.input_tokens, s.output_tokens, s.est_cost_usd) == ("Do", 12, 3, 0.5)


def test_notes(spark, tmp_path):
    import base64

    own = base64.b64encode(b"sess-1").decode()
    for name, text in (("repo/a.md", "# Heading\nx"), (f"{own}/b.md", "y"), ("c.md", "z")):
        write(tmp_path / "memories" / name, text)
    got = {r.title: (r.scope, r.owner_session) for r in R.notes(spark, str(tmp_path)).collect()}
    assert got == {"Heading": ("repo", None), "y": ("session", "sess-1"), "z": ("user", None)}


def test_sqlite_stores(spark, tmp_path):
    store = str(tmp_path / "store.db")
    con = sqlite3.connect(store)
    con.executescript(
        """CREATE TABLE sessions(id TEXT, cwd TEXT, repository TEXT, summary TEXT, created_at TEXT, updated_at TEXT);
        CREATE TABLE turns(session_id TEXT, turn_index INT, user_message TEXT, assistant_response TEXT, timestamp TEXT);
        INSERT INTO sessions VALUES('s', '/w/x', 'own/repo', 'Sum', '2025-01-01T00:00:00Z', NULL);
        INSERT INTO turns VALUES('s', 0, 'hi', 'ho', '2025-01-01T00:00:00Z'), ('s', 1, 'more', NULL, '2025-01-01T00:00:05Z');"""
    )
    con.commit()
    con.close()
    (s,) = R.store_sessions(spark, [store]).collect()
    assert (s.title, s.repository, s.turn_count, s.duration_seconds) == ("Sum", "repo", 2, 5.0)
    kv = str(tmp_path / "kv.db")
    con = sqlite3.connect(kv)
    con.execute("CREATE TABLE cursorDiskKV(key TEXT, value TEXT)")
    put = lambda k, v: con.execute("INSERT INTO cursorDiskKV VALUES(?, ?)", (k, json.dumps(v)))
    put("composerData:c", {"composerId": "c", "name": "N", "createdAt": 1700000000000, "fullConversationHeadersOnly": [{"bubbleId": "1"}, {"bubbleId": "2"}, {"bubbleId": "3"}]})
    put("bubbleId:c:1", {"type": 1, "text": "ask"})
    put("bubbleId:c:2", {"type": 2, "text": "answer", "tokenCount": {"inputTokens": 30, "outputTokens": 4}, "toolFormerData": {"name": "edit", "rawArgs": json.dumps({"target_file": "a.py"}), "result": "ok"}})
    put("bubbleId:c:3", {"type": 2, "text": "refunded", "isRefunded": True, "tokenCount": {"inputTokens": 99, "outputTokens": 9}})
    con.commit()
    con.close()
    (s,) = R.composer_sessions(spark, [kv]).collect()
    assert (s.title, s.input_tokens, s.output_tokens, s.premium_requests) == ("N", 30, 4, 1)
    assert s.turns[0].files == ["a.py"] and "⮑ ok" in s.turns[0].assistant_response
    assert [r.part for r in chunks(R.composer_sessions(spark, [kv])).collect()] == [0]


def test_editor_logs(spark, tmp_path):
    from talkatlas.sources import editor_logs as V

    request = lambda rid, text, parts=(), ts=1700000000000: {"requestId": rid, "timestamp": ts, "message": {"text": text}, "response": list(parts)}
    write(
        tmp_path / "ws1" / "chatSessions" / "s1.jsonl",
        {"kind": 0, "v": {"sessionId": "s1", "creationDate": 1700000000000, "responderUsername": "Helper", "requests": []}},
        {"kind": 2, "v": [request("r1", "First?")]},
        {"kind": 1, "v": {"x": 1}},
        {"kind": 2, "v": [{"value": "Part one "}, {"kind": "thinking", "value": "mull"}]},
        "broken",
        {"kind": 2, "v": [{"value": {"value": "and two."}}, {"kind": "toolInvocationSerialized", "toolId": "grep", "invocationMessage": "Looking"}, {"kind": "codeblockUri", "uri": {"path": "/w/a.py"}}]},
        {"kind": 2, "v": [request("r2", "Second?", [{"value": "Whole"}])]},
    )
    (tmp_path / "ws1" / "chatSessions" / "s2.json").write_text(json.dumps({"sessionId": "s2", "creationDate": 1700000000000, "requests": [request("q", "Old?", ["plain"])]}))
    (tmp_path / "ws1" / "workspace.json").write_text(json.dumps({"folder": "file:///home/u/my%20shop"}))
    got = by_id(V.editor_logs(spark, str(tmp_path)))
    first, second = got["editor-s1"].turns
    assert first.user_message == "First?" and first.assistant_response.startswith("Part one and two.") and "`▷ grep` Looking" in first.assistant_response
    assert (first.thinking, first.tools, first.files) == ("mull", ["grep"], ["/w/a.py"])
    assert (second.user_message, second.assistant_response) == ("Second?", "Whole")
    assert got["editor-s1"].responder == "Helper" and got["editor-s1"].workspace_id == "ws1"
    assert got["editor-s2"].turns[0].assistant_response == "plain"
    (w,) = V.workspaces(spark, str(tmp_path)).collect()
    assert (w.workspace_id, w.repository) == ("ws1", "my shop")


def test_uploads(spark, tmp_path):
    from pyspark.sql import functions as F

    from talkatlas.sources import uploads as U

    (tmp_path / "a.txt").write_bytes("# Tïtle\nbody".encode())
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"x" * 100)
    docs = {r.filename: r for r in U.documents(spark, str(tmp_path), "*.txt").collect()}
    assert docs["a.txt"].title == "Tïtle" and docs["b.txt"].content == "café"
    assert U.document_chunks(U.documents(spark, str(tmp_path), "a.txt")).count() == 1
    kept = U.attachments(spark, str(tmp_path), 50)
    assert kept.count() == 2 and U.verified(kept).count() == 2
    assert U.verified(kept.withColumn("size_bytes", F.lit(1))).count() == 0
    assert U.orphans(kept, kept.limit(1)).count() == 1


def test_import(spark, tmp_path):
    from talkatlas.sources import uploads as U

    (tmp_path / "a.json").write_text(json.dumps({"platform": "robot", "conversation": [{"speaker": "user", "content": "Q"}]}))
    read = lambda: R.flat_exports(spark, str(tmp_path), "robot")
    other = lambda: R.flat_exports(spark, str(tmp_path), "nobody")
    table, counts = U.import_exports(read().limit(0), [other, read])
    assert counts == {"matched": 1, "added": 1, "updated": 0, "skipped": 0, "imported": 1} and table.count() == 1
    assert U.import_exports(table, [read])[1]["skipped"] == 1
