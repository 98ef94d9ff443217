"""Listeners of scripts, checks of behaviour, and the audit over tables made from raw pages."""

import pytest

from claraudit.operators import behaviour
from claraudit.plans import audit as au
from claraudit.plans.extract import page_tables
from claraudit.sources import css, html, scripts


def _read(spark, *bodies):
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    els = css.placed(html.elements(pages))
    return els, scripts.handlers(els, scripts.listeners(els))


@pytest.mark.parametrize(("source", "want"), [
    ("document.addEventListener('keydown', f)", [(("document", None), "keydown", "f")]),
    ("// x.addEventListener('a', b)\n/* y.onclick = z */ 'q.onload = 1'", []),
    ("var r = /a\"b/, s = `x.addEventListener('a', b)`; window.onkeyup = go;", [(("document", None), "keyup", "go")]),
    ("const b = document.getElementById('i'); b.addEventListener(\"Click\", () => { a(')'); }, true)", [(("selector", "#i"), "click", "() => { a(')'); }")]),
    ("document.getElementsByClassName('c')", []),
    ("document.querySelectorAll('.x, y').forEach((el) => el.ondrag = move); function move(e) { go({a: 1}) }", [(("selector", ".x, y"), "drag", "{ go({a: 1}) }")]),
    ("a[0].addEventListener('b', c); get().onfocus = d", [(("unknown", None), "b", "c"), (("unknown", None), "focus", "d")]),
    ("el.addEventListener('", []),
    ("x.addEventListener(type, f); if (a.onclick == b) c", []),
])
def test_listeners(source, want):
    assert scripts.listeners_of(source) == want


def test_any_cut_of_a_script_is_read():
    whole = "var b=document.getElementById('i');b.addEventListener('x',function(){return /[/]\"/.test(`${a}`)});q.forEach(e=>{e.onclick=f});function f(){}"
    for i in range(len(whole)):
        scripts.listeners_of(whole[:i])
        scripts.listeners_of(whole[i:])


def test_character_keys(spark):
    els, own = _read(spark, "<a accesskey='S'>x</a><a accesskey='7'>y</a><p onkeyup=\"event.keyCode == 65\">z</p><p onkeydown=\"event.key == 'a' && event.altKey\">w</p><script>document.onkeypress = e => e.code === '?'</script>", "<p>none")
    assert {(r.page_id, r.kind) for r in behaviour.character_keys(els, own).collect()} == {(0, "accesskey"), (0, "inline-handler"), (0, "script-listener")}


def test_pointer_cancellation(spark):
    els, own = _read(spark, "<b onmousedown='save()'>a</b><i onmousedown='save()' onclick='x'>b</i><input onmousedown='save()'><input type=checkbox ontouchstart='save()'><u onpointerdown='event.preventDefault()'>c</u><s id=s>d</s><script>document.getElementById('s').addEventListener('mousedown', () => fetch(1))</script>")
    assert [r.tag for r in behaviour.pointer_cancellation(els, own).orderBy("pos").collect()] == ["b", "input", "s"]


def test_dragging(spark):
    els, own = _read(spark, "<div><div><i draggable=true></i></div><button>x</button></div><div><i draggable=true></i><a href=x>y</a></div><div><p class='ui-draggable'><input type=submit></p></div><b ontouchstart='a' ontouchmove='b'></b><em data-sortable draggable=false></em>")
    assert [(r.kind, r.alternative) for r in behaviour.dragging(els, own).orderBy("pos").collect()] == [("native", False), ("native", True), ("library", True), ("pointer", False)]


def test_status_messages(spark):
    els, _ = _read(spark, "<form></form>", "<form></form><p aria-live=off></p>", "<p role=alert>" + "<i>" * 60 + "<b class=toast aria-invalid=true>", "<p>x", "<i class='badge' aria-label='3 unread'>3</i>")
    got = {r.page_id: (r.contexts, r.live, r.not_atomic, r.invalid, r.status) for r in behaviour.status_messages(els).collect()}
    assert got == {0: ("form", 0, 0, 0, "fail"), 1: ("form", 1, 0, 0, "incomplete"), 2: ("", 1, 1, 0, "pass"), 3: ("", 0, 0, 0, "incomplete"), 4: ("cart", 0, 0, 0, "fail")}


def test_audit_of_raw_pages(spark):
    bad = """<html><style>.f { display: flex; flex-direction: column-reverse } @keyframes k {} .m { animation: k 9s }</style><body><form><input name="email" required></form><div class=f><p>a<p>b</div>
      <button aria-label="Send">Go now</button><audio src="x.mp3"></audio><p class="m">Click the round button.</p><div><i draggable="true">d</i></div><b accesskey="s">s</b></body></html>"""
    pages = spark.createDataFrame([(1, "http://bad.example/", bad), (2, "http://good.example/", "<html><body><p>fine</p></body></html>")], "page_id long, url string, html string")
    report = au.audit(spark, page_tables(pages), au.AuditConfig(level="AAA"))
    rows = report.findings.select("wcag_sc", "status", "element.page_url" if "page_url" in report.findings.select("element.*").columns else "page_url").collect()
    worst = {(r.wcag_sc, r.status) for r in rows if r.page_url == "http://bad.example/" and r.status != "pass"}
    assert worst >= {("3.3.1", "fail"), ("3.3.2", "fail"), ("2.5.3", "fail"), ("1.2.1", "fail"), ("2.2.2", "fail"), ("1.3.2", "needs_review"), ("1.3.3", "fail"), ("2.1.4", "needs_review"), ("2.5.7", "needs_review"), ("4.1.3", "fail")}
    assert {r.wcag_sc for r in rows if r.page_url == "http://good.example/" and r.status == "fail"} == set()


def test_entry_fields(spark):
    from claraudit.operators.entry_fields import entry_fields

    page = """<form class="newsletter"><input autocomplete="section-x home tel" name=q><input type=email><input name="memo"><input aria-label="お名前" value=x><input type=email aria-label="もう一度"><input name="city" disabled></form>
      <fieldset id="Billing">""" + "<div>" * 50 + """<label>Zip code<select aria-required=true></select></label></fieldset>"""
    els, _ = _read(spark, page)
    got = {(r.key, r.form >= 0, r.process, r.role, r.required, r.prefilled) for r in entry_fields(els.drop("parent", "prev", "next", "classes", "id")).collect()}
    assert got == {("tel", True, "subscribe", None, False, False), ("email", True, "subscribe", None, False, False), ("given-name", True, "subscribe", None, False, True), ("postal-code", False, "checkout", "billing", True, False)}


def test_all_containers_of_a_page_are_audited(spark):
    page = "<style>.f { display: flex } .r { display: flex; flex-direction: row-reverse }</style>" + "<div class=f><p>a</p><p>b</p></div>" * 2000 + "<div class=r><p>a</p><p>b</p></div>"
    pages = spark.createDataFrame([(1, "http://p/", page)], "page_id long, url string, html string")
    found = au.audit(spark, page_tables(pages), au.AuditConfig(level="AAA", criteria=("1.3.2",))).findings
    assert [r.status for r in found.collect()] == ["needs_review"]


LONG = "/* " + "x" * 5000 + " */ " + "y(); " * 1000


def test_character_keys_far_inside_a_handler(spark):
    els, own = _read(spark, f"<script>function go(e) {{ {LONG} if (e.key === 'q') z() }} document.addEventListener('keydown', go)</script>", f"<script>document.onkeyup = e => {{ {LONG} if (e.altKey && e.key === 'q') z() }}</script>")
    assert [(r.page_id, r.kind, r.detail) for r in behaviour.character_keys(els, own).collect()] == [(0, "script-listener", ".key === 'q'")]


def test_pointer_cancellation_far_inside_a_handler(spark):
    els, own = _read(spark, f"<b id=b>x</b><i id=i>y</i><script>document.getElementById('b').onmousedown = () => {{ {LONG} save() }}; document.getElementById('i').onmousedown = () => {{ {LONG} look() }}</script>")
    assert [r.tag for r in behaviour.pointer_cancellation(els, own).collect()] == ["b"]


def test_whole_handlers_are_handed_on_in_parts():
    import pyarrow as pa

    source = f"function f() {{ {LONG} }} " + "document.onclick = f; " * 3000
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "pos": pa.array([0], pa.int32()), "text": [source]})
    made = [(b.num_rows, b.nbytes) for b in scripts._listeners(iter([batch]))]
    assert sum(n for n, _ in made) == 3000 and max(size for _, size in made) < 2 * html.CHARS_MADE
