"""The scanner of web languages, and linking of what it finds."""

import pytest

from brindle.functions.web_units import Scanner, Unreadable, base_of, web_unit
from brindle.plans.snapshot import Snapshot


def facts(path, text):
    u = web_unit(path, text if isinstance(text, bytes) else text.encode())
    calls = [(c["symbol"].partition(":")[2], c["kind"], c["name"] or c["export"]) for c in (u["web"] or {"calls": []})["calls"]]
    return u, {s["name"]: s for s in u["symbols"]}, calls


def test_definitions_and_exports():
    u, symbols, _ = facts("lib/tax.ts", """// café
import type { Rate } from './rate';
export function* rates(): Iterable<Rate> { yield 1 }
export const net = async <T,>(x: T): Promise<T> => {
  return x
}, gross = function () { return 2 }
const plain = 3
export default class Table<T> extends Base(x) {
  @cached() private size: number = 1
  rows = () => 1
  static of(a: number): Table { return new Table() }
  get total() { return 1 }
  [Symbol.iterator]() {}
  #hidden() {}
  later(a: string): void
  later(a: any) {}
}
function over(a: string): void;
function over(a: any) {}
export { plain as constant, type Rate, over }
interface Shape { area(): number }
type Maybe = { f(): void } | null
declare function elsewhere(): void
enum Kind { A = 1 }
""")
    assert list(symbols) == ["rates", "net", "gross", "Table.of", "Table.total", "Table.later", "over"]
    assert (symbols["net"]["start"], symbols["net"]["end"]) == (4, 6) and symbols["net"]["source"].startswith("export const net") and symbols["Table.of"]["source"] == "static of(a: number): Table { return new Table() }"
    assert symbols["rates"]["preamble"] == "import type { Rate } from './rate';" and symbols["rates"]["module"] == "lib.tax" and symbols["Table.of"]["owner"] == "Table"
    assert {(e["export"], e["local"]) for e in u["web"]["exports"]} == {("rates", "rates"), ("net", "net"), ("gross", "gross"), ("constant", "plain"), ("over", "over")}
    assert u["warnings"] == [] and u["hash"]


def test_calls_and_what_hides_them():
    _, _, calls = facts("a.ts", """import first, { one as two, type T } from './b'
import * as all from './b'
export function direct() { two(); first<T>(1); all.three?.(); missing(); all.x.y(); new two(); super_() }
export function parameter({ k: two, ...rest }: P, [first] = []) { two(); first(); rest() }
export function local() { try { two() } catch (two) {} }
export function later() { for (const two of []) {} two() }
export function nested() { const f = () => two(); function g() { first() } return [1].map(x => two(x)) }
export function objects() { return { two() { first() }, k: function () { two() }, v: two(1) } }
export const own = function first() { return first() }
export function types(): void { const x: Map<string, (a: number) => void> = all.three(); if (x) (two as any)(); return }
export function text() { return `a ${two(`${first()}`)} } {` + /two\\(\\)[/(]/.test('two()') }
""")
    told = {}
    for name, kind, what in calls:
        told.setdefault(name, []).append((kind, what))
    assert told["direct"] == [("import", "one"), ("import", "default"), ("import", "three"), ("local", "missing"), ("unresolved", None), ("local", "super_")]
    for name in ("parameter", "local", "later", "own"):
        assert {k for k, _ in told[name]} == {"unresolved"}, name
    assert told["nested"] == [("unresolved", None)]
    assert ("import", "one") not in told["objects"] or told["objects"].count(("import", "one")) == 1
    assert ("import", "default") not in told["objects"]
    assert told["text"][:2] == [("import", "one"), ("import", "default")]


def test_own_methods():
    _, _, calls = facts("c.js", "class C { static run() { this.one(); this.two() } one() { this.three?.(); this.#p() } static two() {} three() {} }")
    assert calls == [("C.run", "unresolved", None), ("C.run", "local", "C.two"), ("C.one", "local", "C.three"), ("C.one", "unresolved", None)]


@pytest.mark.parametrize("text, said", [
    ("export function f( {", "Cannot parse"), ("const s = 'open", "Cannot parse"), ("let t = `open ${x}", "Cannot parse"), ("/* open", "Cannot parse"), (b"// \xff", "invalid UTF-8"),
    ("export default () => 1", "anonymous/default"), ("export { a } from './b'", "re-export"), ("export * from './b'", "re-export"), ("const x = require('y')", "CommonJS"),
    ("import { a } from 'pkg'", "package/alias"), ("import { a } from './b'; import a from './c'", "Ambiguous import"), ("function f() {} function f() {}", "Ambiguous duplicate"),
    ("export { a as x, b as x }", "Ambiguous ESM export"), ("let f = () => 1\nf = () => 2", "Reassigned"), ("import x = require('y')", "Unsupported import"),
])
def test_what_is_said(text, said):
    u, _, _ = facts("a.ts", text)
    assert any(said in w for w in u["warnings"]), u["warnings"]
    assert (u["hash"] is None) == (said in ("Cannot parse", "invalid UTF-8"))


def test_elements_are_passed_over():
    u, symbols, calls = facts("v.tsx", "export function V() { return <div title=\"it's\" on={() => go()}>it's {items.map(i => <b key={i}>{i}</b>)} <br/></div>; }\nexport const W = () => <V.X />;\nconst less = a < b && c > d\nfunction g() { return go() }\n")
    assert list(symbols) == ["V", "W", "g"] and calls == [("g", "local", "go")] and any("JSX" in w for w in u["warnings"])
    with pytest.raises(Unreadable):
        Scanner("const x = <div>", True)


def test_lines_without_semicolons():
    _, symbols, calls = facts("a.js", "const a = 1\nconst f = x => g(x)\nconst h = () => ({ a })\n\nlet y = a\n  .then(() => 2)\nfunction g() {\n  f(1)\n  ;[1].map(f)\n}\n")
    assert list(symbols) == ["f", "h", "g"] and symbols["f"]["source"] == "const f = x => g(x)"
    assert calls[:2] == [("f", "local", "g"), ("g", "local", "f")]


def test_base_of():
    assert [base_of("a/b.ts", m) for m in ("./c", "../c", "../../c", "pkg", ".\\c")] == ["a/c", "c", None, None, None]


def test_linking(spark):
    rows = {
        "billing.ts": "export function round(x: number) { return x }\nexport default function total(xs: number[]) { return round(sum(xs)) }\n",
        "checkout.ts": "import calculate, { round as r } from './billing.js'\nimport * as all from './billing'\nexport const pay = () => calculate()\nexport function cents() { return r(1) + all.round(2) }\n",
        "both.ts": "export function x() {}", "both.js": "export function x() {}", "use.ts": "import { x } from './both'\nexport function f() { x() }\n",
        "lib/index.ts": "export function deep() {}", "far.mjs": "import { deep } from './lib'\nexport function go() { deep() }\n",
        "gone.ts": "function a() { return 1 }\nlet b = () => a()\nb = () => 2\nexport function c() { b() }\n", "p.py": "def work():\n    return 1\n",
    }
    snap = Snapshot.of_files(spark, spark.createDataFrame([(p, t.encode()) for p, t in rows.items()], "path string, content binary"))
    assert {(r.src, r.dst) for r in snap.edges.collect()} == {
        ("billing.ts:total", "billing.ts:round"), ("checkout.ts:pay", "billing.ts:total"), ("checkout.ts:cents", "billing.ts:round"),
        ("far.mjs:go", "lib/index.ts:deep"), ("gone.ts:b", "gone.ts:a"),
    }
    assert "Unresolved calls (1) in use.ts:f; dynamic/type/JSX dispatch is not modeled" in snap.warnings
    assert {r.id: r.language for r in snap.symbols.collect()}["far.mjs:go"] == "javascript"


WRONG = (
    "let let = = 5", "export function f() { return 1 +; }", "if return", "const a = ;", "a = (1 && );", "f(, = 2)", "x === === y", "while true {}", "const x = 5 6;", 'const s = "a" "b";',
    "const const a = 1", "for x of y {}", "let y = 3 abc", "const z = a ||", "export function broken( {",
)
RIGHT = (
    "const p = a\n  + b, q = -1;\nlet r = +p ** 2;", "class A { if = 1; for; let = 2; static const = 3; get if() { return this.if; } while() {} }", "type M<T> = { -readonly [K in keyof T]-?: T[K] } & { +readonly a?: 1 };",
    "const o = { if: 1, for: 2, let: 3, return: 4, class() {} }; o.if = o.for + o.return; o?.while;", "function* g() { yield* g(); yield; }", "export * from './a';\nimport * as b from './b';\nexport { x as if, y as for };",
    'import d from "./d.json" with { type: "json" };', "let x!: number; x! = 3; const y = x!;", "const f = (a?: number, b = 2, ...c: string[]) => a ?? b;", "for await (const x of y) {}\ndo {} while (x)\ntry {} catch {} finally {}",
    "const t = `a${1 + 2}b${`c${3}`}`, u = `x`;", "const c = [1, , 3], [a, , b = 2] = c; ({ a, ...b } = c);", "let v = x as const\nlet w = <const>[1];", 'type U = "a" | "b"; type C = T extends "a" ? 1 : 2; const n = "k" in o, i = 1 in o;',
    "const re = /a+/g, d = a / b / c; a ||= b; a **= 2; a >>>= 1;", "label: for (;;) { continue label }\nif (a) b; else if (c) d", "type G<T = Array<number>> = T; let g: Array<Array<number>>= [];", "const big = 10n, h = 0xffn, e = 1e-7, s = 1_000;", "async function q() { await (async () => 1)() }",
    "enum E { A = 1, B = A << 2 }\nconst enum F { X }\nabstract class Z<T> extends Y<T> implements W { constructor(private readonly a = 1) { super() } }", "export default class {}\nexport = x;", "const neg = !a, inv = ~b, t2 = typeof a === 'string', del = delete o.a, vd = void 0;", "",
    "a\n++b\nc--\nd", "let yes = a ? b : c, no = a ? -b : +c;", "case1: 5\n6", '"use strict"\n"other"', "const get = 1, set = 2, of = 3, from = 4; from + of;",
)


@pytest.mark.parametrize("text", WRONG)
def test_syntax_errors_give_no_symbols(text):
    unit = web_unit("a.ts", f"export function good() {{ return 1; }}\n{text}\n".encode())
    assert unit["hash"] is None and not unit["symbols"] and "a.ts" in unit["warnings"][0]


@pytest.mark.parametrize("text", RIGHT)
def test_valid_files_are_read(text):
    unit = web_unit("a.ts", f"export function good() {{ return 1; }}\n{text}\n".encode())
    assert unit["hash"] is not None, unit["warnings"]
    assert "a.ts:good" in {s["id"] for s in unit["symbols"]}
