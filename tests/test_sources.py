"""Tokens, declarations and test suites of source texts."""

import random

import pytest

from tessellary.sources import code, declarations, lexer, suites

SERVICE = """
import { Injectable } from '@scope/common';

/**
 * What a shop knows of a buyer.
 */
export interface Buyer {
  id: string;
  tags: Map<string, string[]>;
  age?: number;
  greet(loud: boolean): void;
}

/**
 * Keeps buyers.
 * @see Buyer
 */
@Injectable({ scope: "one, two" })
export class BuyerStore<T extends Buyer = Buyer> extends Base<T> implements Store<T, string>, Closing {
  private buyers: Map<string, T> = new Map<string, T>()
  static readonly #limit = 10; pattern = /[}/]"/g
  [key: string]: unknown

  constructor(private readonly log: Log, size = 3) { super(); const inner = `a ${size + `}`} b`; }

  /** Adds one. */
  async add(buyer: T, ...rest: string[]): Promise<T> { return buyer }
  protected abstract find(id?: string): T | undefined
  get count() { return 1 }
}

export type Role = 'admin' | 'user';
export const PAGE = 10, load = async (url: string): Promise<void> => { let hidden = 1 }
export enum Color { Red = 1, Green = "}" }
function plain() {}
"""
BEAN = """
import java.util.List;
/**
 * A bean.
 * @since 1
 */
@Entity(name = "b")
public final class Bean<T extends Comparable<T>> extends Root<T> implements A, B<C, D> {
    private static final int X = 1, Y = 2;
    public Bean(final String id) {}
    @Override protected <R> Map<String, List<R>> all(Map<String, R> in, int... n) throws IOException { return null; }
    enum Kind { ONE(1), TWO { void f() {} }; private final int c; }
    interface Inner { void run(); }
}
"""


def rows(spark, language, *texts):
    df = spark.createDataFrame([(f"f{i}", language, t, "z") for i, t in enumerate(texts)], "path string, language string, content string, ordinal string")
    return declarations.declarations(df).orderBy("path", "ordinal").collect()


def test_typescript_declarations(spark):
    found = rows(spark, "typescript", SERVICE)
    names = {r.ordinal: r.name for r in found}
    assert [(r.name, r.kind, names.get(r.parent)) for r in found] == [
        ("Buyer", "interface", None), ("id", "property", "Buyer"), ("tags", "property", "Buyer"), ("age", "property", "Buyer"), ("greet", "method", "Buyer"),
        ("BuyerStore", "class", None), ("buyers", "property", "BuyerStore"), ("#limit", "property", "BuyerStore"), ("pattern", "property", "BuyerStore"),
        ("constructor", "constructor", "BuyerStore"), ("add", "method", "BuyerStore"), ("find", "method", "BuyerStore"), ("count", "accessor", "BuyerStore"),
        ("Role", "type-alias", None), ("PAGE", "constant", None), ("load", "constant", None), ("Color", "enum", None), ("Red", "enum-member", "Color"),
        ("Green", "enum-member", "Color"), ("plain", "function", None),
    ]
    by = {r.name: r for r in found}
    store = by["BuyerStore"]
    assert (store.line, store.end_line, store.extends, store.implements) == (18, 30, ["Base<T>"], ["Store<T, string>", "Closing"])
    assert [(d.name, d.arguments) for d in store.decorators] == [("Injectable", ['{ scope: "one, two" }'])]
    assert [tuple(g) for g in store.generics] == [("T", "Buyer", "Buyer")]
    assert (store.description, store.modifiers, store.exported) == ("Keeps buyers.", ["export"], True)
    assert "@see Buyer" in store.documentation
    assert [tuple(p) for p in by["constructor"].parameters] == [("log", "Log", False, None), ("size", "any", True, "3")]
    assert [tuple(p) for p in by["add"].parameters] == [("buyer", "T", False, None), ("rest", "string[]", True, None)]
    assert (by["add"].type, by["add"].modifiers, by["add"].description) == ("Promise<T>", ["async"], "Adds one.")
    assert (by["buyers"].type, by["tags"].type, by["find"].type) == ("Map<string, T>", "Map<string, string[]>", "T | undefined")
    assert (by["Role"].type, by["Green"].type, by["plain"].signature) == ("'admin' | 'user'", '"}"', "plain(): any")


def test_java_declarations(spark):
    found = rows(spark, "java", BEAN)
    names = {r.ordinal: r.name for r in found}
    assert [(r.name, r.kind, names.get(r.parent)) for r in found] == [
        ("Bean", "class", None), ("X", "field", "Bean"), ("Y", "field", "Bean"), ("Bean", "constructor", "Bean"), ("all", "method", "Bean"), ("Kind", "enum", "Bean"),
        ("ONE", "enum-member", "Kind"), ("TWO", "enum-member", "Kind"), ("c", "field", "Kind"), ("Inner", "interface", "Bean"), ("run", "method", "Inner"),
    ]
    bean, method = found[0], found[4]
    assert (bean.extends, bean.implements, bean.modifiers, bean.description) == (["Root<T>"], ["A", "B<C, D>"], ["public", "final"], "A bean.\n@since 1")
    assert (method.type, [tuple(p) for p in method.parameters]) == ("Map<String, List<R>>", [("in", "Map<String, R>", False, None), ("n", "int...", False, None)])
    assert [d.name for d in method.decorators] == ["Override"]


def test_odd_texts_have_no_or_some_declarations(spark):
    assert rows(spark, "typescript", None, "", "   ", "// only", "class") == []
    assert rows(spark, "cobol", SERVICE) == []
    assert [r.name for r in rows(spark, "typescript", "const a = `${ `x` }` // class No {}\nlet b = 'class Nor {}'; if (x) { class Inside {} }")] == ["a", "b"]
    assert [r.name for r in rows(spark, "typescript", "class A {" + " x: number;" * 2000)][:2] == ["A", "x"]


@pytest.mark.parametrize("language", ["typescript", "java"])
def test_any_text_can_be_read(language):
    parts = ["class", "A", "{", "}", "(", ")", "<", ">", ",", ";", ":", "=", "=>", "?", "function", "const", "enum", "interface", "type", "export", "@", "extends", "`", "'", "\n", "[", "]", "*", "${"]
    rng = random.Random(language)
    for _ in range(3000):
        text = " ".join(rng.choices(parts, k=rng.randint(1, 25)))
        reader = declarations._Reader("p", text, language)
        reader.block(0, reader.size)
        found = lexer.tokens(text, language)
        assert "".join(t.text for t in found).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
        suites.scopes(text, language)


def test_files_of_a_tree_keep_their_members(spark, tmp_path):
    (tmp_path / "a.ts").write_text(SERVICE)
    files = code.read_tree(spark, str(tmp_path))
    assert code.symbols(files).count() == 7 and code.symbols(files, members=True).count() == 20


CASES = """
describe('outer', () => {
  beforeEach(() => { expect(setup).toBe(1) })
  describe("inner", function () {
    it(`works with ${'x'}`, async () => {
      const r = run('it("no")'); // it('nor', ...)
      expect(r.value).not.toBe(3);
      await expect(promise).rejects.toThrow('x')
    })
    it.skip('waits', () => {})
  })
  test.each([1, 2])('number %i', (n) => { assert.equal(n, 1) })
})
"""
UNIT = """class CalcTest { @Test void adds() { assertEquals(4, add(2, 2)); } void helper() { assertTrue(x); } @ParameterizedTest public void many(int n) { Assertions.assertAll(() -> x()); } }"""


def test_suites_cases_and_assertions(spark):
    df = spark.createDataFrame([("a", "typescript", CASES), ("b", "java", UNIT), ("c", "typescript", None), ("d", "typescript", "x()")], "path string, language string, content string")
    got = [(r.path, r.kind, r.name, r.suite, r.mark, r.assertions) for r in suites.suites(df).orderBy("path", "ordinal").collect()]
    assert got == [
        ("a", "suite", "outer", None, None, []), ("a", "suite", "inner", "outer", None, []),
        ("a", "case", "works with ${'x'}", "outer > inner", None, ["expect(r.value).not.toBe(3)", "expect(promise).rejects.toThrow('x')"]),
        ("a", "case", "waits", "outer > inner", "skip", []), ("a", "case", "number %i", "outer", "each", ["assert.equal(n, 1)"]),
        ("b", "suite", "CalcTest", None, None, []), ("b", "case", "adds", "CalcTest", None, ["assertEquals(4, add(2, 2))"]),
        ("b", "case", "many", "CalcTest", None, []),
    ]


MODULE = """
import fs from 'fs'; import type { A, B as C } from "./types";
import React, { useState } from 'react'
import * as path from '/abs/path';
import './side-effect';
// import { no } from 'comment'
const s = "import { nor } from 'string'"; const lazy = import('later'); x.import
export { one, two as three } from './two'; export * from './all'; export * as names from './names'
export default class Main {}
export const limit = 1; export async function run() {}
export type { Kind }
{ export_me() }
"""


def test_imports_and_exports(spark):
    from tessellary.sources import modules

    java = "import java.util.List;\nimport static a.B.*;\nclass X { void f() { } }"
    df = spark.createDataFrame([("m.ts", "typescript", MODULE), ("X.java", "java", java), ("n.ts", "typescript", None), ("o.py", "python", "import x")], "path string, language string, content string")
    got = [(r.path, r.source, r.specifiers, r.is_default, r.is_namespace, r.is_external) for r in modules.imports(df).orderBy("path", "ordinal").collect()]
    assert got == [
        ("X.java", "java.util.List", ["List"], False, False, True), ("X.java", "a.B.*", [], False, True, True), ("m.ts", "fs", [], True, False, True),
        ("m.ts", "./types", ["A", "B"], False, False, False), ("m.ts", "react", ["useState"], True, False, True), ("m.ts", "/abs/path", [], False, True, False), ("m.ts", "./side-effect", [], False, False, False),
    ]
    names = [(r.name, r.is_default) for r in modules.exports(df).orderBy("ordinal").collect()]
    assert names == [("one", False), ("three", False), ("default", True), ("limit", False), ("run", False), ("Kind", False)]


def test_changes_of_declarations(spark):
    from tessellary.operators import code_graph

    before = "/** Doc */\nclass A { run(x: number): void {} }\ninterface I { a: string }\nfunction gone() {}\nconst same = 1"
    after = "/** Doc */\nclass A { run(x: string): void {} }\ninterface I { a: string }\nfunction came() {}\nconst same = 2"
    read = lambda text: declarations.declarations(spark.createDataFrame([("f", "typescript", text), ("g", "typescript", "class B {}")], "path string, language string, content string"))
    got = {(r.kind, r.name, r.change) for r in code_graph.declaration_changes(read(before), read(after)).collect()}
    assert got == {("class", "A", "modified"), ("function", "gone", "deleted"), ("function", "came", "added")}
    assert code_graph.declaration_changes(read(before), read(before)).collect() == []
    moved = {(r.name, r.change) for r in code_graph.declaration_changes(read(before), read("\n" + before)).collect()}
    assert moved == {("A", "modified"), ("I", "modified")}
