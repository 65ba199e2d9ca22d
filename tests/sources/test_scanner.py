"""Small snippets of each language, and what must be read from them."""

import pytest

from archloom.sources.scanner import blanked, parse


def read(language, path, text):
    out = parse(text, path, language)
    return out, {d.name: d for d in out.declarations}


def kinds(out):
    return sorted(f"{d.kind}:{d.name}" for d in out.declarations)


def test_python():
    out, by = read("python", "pkg/svc.py", "import os\n\nclass Service(Base, db.Mixin):\n    def run(self):\n        helper()\n        self.conn.commit()\n\n@wraps\ndef helper():\n    return 1\n\ndef _own(): pass\ndef __all__(): pass\n")
    assert kinds(out) == ["class:Service", "function:__all__", "function:_own", "function:helper"]
    s = by["Service"]
    assert (s.line, s.namespace, s.supertypes, s.method_count) == (3, "pkg.svc", ["Base", "db.Mixin"], 1) and {"helper", "commit"} <= set(s.refs)
    assert [by[n].visibility for n in ("helper", "_own", "__all__")] == ["public", "private", "public"]
    assert read("python", "pkg/__init__.py", "class A:\n    pass\n")[1]["A"].namespace == "pkg"
    assert parse("def broken(:", "x.py", "python").skipped == [(0, "exception: SyntaxError")]


def test_typescript():
    out, by = read("typescript", "src/api/svc.ts", "import { Base } from './base';\nexport interface Repo extends Base {\n  save(): void;\n}\nexport class Service extends Base implements Repo {\n  run() {\n    helper();\n    return new Widget();\n  }\n}\nfunction helper() { return 1; }\nexport type Id = string;\n")
    assert kinds(out) == ["class:Service", "function:helper", "interface:Repo", "type_alias:Id"]
    s = by["Service"]
    assert (s.line, s.namespace, sorted(s.supertypes), s.method_count) == (5, "api.svc", ["Base", "Repo"], 1)
    assert {"helper", "Widget"} <= set(s.refs) and "./base" not in s.refs and by["Repo"].supertypes == ["Base"]
    assert (by["helper"].visibility, s.visibility) == ("private", "public") and "function helper" in by["helper"].signature
    assert "render" in read("typescript", "src/ui/App.tsx", "export function App() {\n  return <div>{render()}</div>;\n}\n")[1]["App"].refs


def test_typescript_bindings_and_reexports():
    out, _ = read("typescript", "src/x.ts", "import Default from './d';\nimport { A, B as C } from './m';\nimport * as NS from './ns';\nexport * from './a';\nexport { x, y as z } from './b';\nexport * as ns from './c';\nexport const local = 1;\n")
    assert {i.raw: i.bindings for i in out.imports} == {"./d": [("Default", "default")], "./m": [("A", "A"), ("C", "B")], "./ns": [("NS", "*")]}
    assert {r.source: (r.star, r.alias, r.names) for r in out.reexports} == {"./a": (True, None, []), "./b": (False, None, [("x", "x"), ("z", "y")]), "./c": (True, "ns", [])}


def test_go():
    out, by = read("go", "cmd/api/server.go", 'package server\n\nimport "net/http"\n\ntype Reader interface {\n\tRead() string\n}\n\ntype RW interface {\n\tReader\n\tClose() error\n}\n\ntype Server struct {\n\tport int\n}\n\nfunc (s *Server) Start() {\n\thelper()\n}\n\nfunc helper() {\n\thttp.Get("x")\n}\n\ntype Handler func(int) error\n')
    assert {n: d.kind for n, d in by.items()} == {"Reader": "interface", "RW": "interface", "Server": "struct", "Start": "method", "helper": "function", "Handler": "type_alias"}
    assert by["Server"].namespace == "cmd.api.server" and by["Start"].namespace == "cmd.api.server.Server"
    assert (by["Reader"].line, by["Reader"].method_count, by["RW"].method_count, by["Server"].method_count) == (5, 1, 1, 1)
    assert by["RW"].supertypes == ["Reader"] and "helper" in by["Start"].refs and "Get" in by["helper"].refs
    assert [(i.raw, i.alias) for i in out.imports] == [("net/http", "http")]


def test_rust():
    out, by = read("rust", "src/api/order.rs", "use std::collections::HashMap;\nuse foo::bar::Baz as Qux;\n\nstruct Service {\n    count: u32,\n}\n\ntrait Run : Send + Sync {\n    fn run(&self);\n}\n\nimpl Service {\n    fn start(&self) {\n        helper();\n        println!(\"go\");\n    }\n}\n\nfn helper() -> u32 {\n    Type::assoc();\n    vec![1]\n}\n")
    assert kinds(out) == ["function:helper", "struct:Service", "trait:Run"]
    assert (by["Service"].line, by["Service"].namespace, by["Service"].method_count) == (4, "api.order", 1)
    assert sorted(by["Run"].supertypes) == ["Send", "Sync"] and by["Run"].method_count == 1
    assert {"assoc", "vec"} <= set(by["helper"].refs) and by["helper"].signature.startswith("fn helper")
    assert ("foo::bar::Baz", "Qux") in {(i.qualified, i.alias) for i in out.imports}
    assert read("rust", "lib.rs", "fn driver() {}\n")[1]["driver"].namespace is None


def test_java():
    out, by = read("java", "src/Service.java", "package com.example.app;\n\nimport java.util.List;\n\npublic class Service extends Base<T> implements Runnable {\n    public void run() {\n        helper();\n        Widget w = new Widget();\n    }\n}\ninterface Shape {}\nrecord Point(int x, int y) {}\nenum Color { RED, GREEN }\n")
    assert kinds(out) == ["class:Service", "enum:Color", "interface:Shape", "record:Point"]
    s = by["Service"]
    assert (s.line, s.namespace, s.supertypes, s.method_count) == (5, "com.example.app", ["Base", "Runnable"], 1) and {"helper", "Widget", "java.util.List"} <= set(s.refs)


def test_kotlin():
    out, by = read("kotlin", "src/Order.kt", "package com.app.domain\n\nimport com.app.data.Repo\n\ninterface Service\n\nclass OrderService(val repo: Repo) : Service {\n    fun run() {\n        Repo()\n    }\n}\n\ndata class User(val id: Int)\n\nobject Registry\n\n@Composable\nfun HomeScreen() {\n    render()\n}\n\n@Composable\nfun helperWidget() {}\nfun plain() {}\n")
    assert kinds(out) == ["class:OrderService", "composable_function:HomeScreen", "data_class:User", "interface:Service", "object:Registry"]
    s = by["OrderService"]
    assert (s.line, s.namespace, s.supertypes, s.method_count) == (7, "com.app.domain", ["Service"], 1) and {"Repo", "com.app.data.Repo"} <= set(s.refs)


def test_csharp():
    out, by = read("csharp", "src/OrderService.cs", "using System;\nusing System.Collections.Generic;\n\nnamespace App.Services\n{\n    public interface IRepo { }\n\n    public class OrderService : IRepo, IDisposable\n    {\n        public void Run()\n        {\n            var repo = new Repository();\n            repo.Save();\n        }\n    }\n}\n")
    assert kinds(out) == ["class:OrderService", "interface:IRepo"]
    s = by["OrderService"]
    assert (s.line, s.namespace, s.supertypes, s.method_count) == (8, "App.Services", ["IRepo", "IDisposable"], 1) and {"Repository", "Save", "System"} <= set(s.refs)
    _, by = read("csharp", "Core.cs", "namespace Acme.Core;\n\npublic struct Point { }\n\npublic class Outer\n{\n    public enum Color { Red, Green }\n}\n")
    assert {n: d.namespace for n, d in by.items()} == {"Point": "Acme.Core", "Outer": "Acme.Core", "Color": "Acme.Core.Outer"}


def test_c():
    out, by = read("c", "src/geom/point.c", "#include <stdio.h>\n\nstruct Point {\n    int x;\n};\n\nint add(int a, int b) {\n    return helper(a, b);\n}\ntypedef struct Node Node;\nstatic int *make(void) {\n    return alloc();\n}\n#if X\nvoid init( void ) {\n    setup();\n}\n#else\nvoid init( void ) { other(); }\n#endif\nstatic portTASK_FUNCTION( prvTask, arg )\n{\n    work();\n}\nint proto(int);\n")
    assert kinds(out) == ["function:add", "function:init", "function:make", "function:prvTask", "struct:Point", "typedef:Node"]
    assert (by["Point"].line, by["Point"].namespace, by["add"].line) == (3, "geom.point", 7) and "helper" in by["add"].refs
    assert by["make"].visibility == "private" and by["init"].refs == ["setup"]
    assert (by["prvTask"].confidence, by["prvTask"].tags) == ("low", ["macro-defined"]) and "work" in by["prvTask"].refs
    assert [(i.raw, i.qualified) for i in out.imports] == [("stdio.h", None)]


def test_cpp():
    out, by = read("cpp", "src/engine/engine.cpp", '#include <vector>\n#include "engine/core.h"\n\nnamespace app {\n\nclass Engine : public Base, private util::Mixin {\npublic:\n  void run() {\n    helper();\n    auto* p = new Widget();\n  }\n  int tick() { return 0; }\n};\n\nvoid freeFunc() {\n  doThing();\n}\n\n}  // namespace app\n')
    e = by["Engine"]
    assert (e.kind, e.line, e.namespace, e.supertypes, e.method_count) == ("class", 6, "app", ["Base", "util::Mixin"], 2) and {"helper", "Widget"} <= set(e.refs)
    assert by["freeFunc"].namespace == "app" and sorted(i.alias for i in out.imports) == ["core.h", "vector"]
    out, by = read("cpp", "lib/geom/shapes.cpp", "enum Color { RED, GREEN };\nstruct Point { int x; };\n#ifdef L\nvoid log() {\n  sink();\n}\n#endif\nnamespace a { class W { public: void f() {} }; }\nnamespace b { class W { public: void g() {} }; }\n")
    assert kinds(out) == ["class:W", "class:W", "enum:Color", "function:log", "struct:Point"] and by["Color"].namespace == "geom.shapes"


def test_swift():
    out, by = read("swift", "Sources/App/Svc.swift", 'import Foundation\n\nprotocol Greeter {\n    func greet()\n}\n\nstruct Point {\n    var x: Int\n}\n\nclass Service: Greeter {\n    func run() {\n        helper()\n    }\n}\n\nfunc helper() {\n    print("hi")\n}\n\nextension Service: Codable {\n    func load() {\n        decode()\n    }\n}\npublic extension Stream {\n    func map<R>(_ t: @escaping (Element) -> R) -> Stream<R> {\n        Map(source: self)\n    }\n}\n')
    assert kinds(out) == ["class:Service", "function:helper", "function:map", "protocol:Greeter", "struct:Point"]
    s = by["Service"]
    assert (s.line, s.namespace, s.supertypes, s.method_count) == (11, "App.Svc", ["Greeter", "Codable"], 2) and {"helper", "decode", "Foundation"} <= set(s.refs)
    assert by["map"].tags == ["extension-method"] and "Map" in by["map"].refs


def test_objc():
    out, by = read("objc", "src/Service.m", '#import <Foundation/Foundation.h>\n#import "Greeter.h"\n\n@protocol Greeter\n- (void)greet;\n@end\n\n@interface Service : NSObject <Greeter>\n- (void)run;\n@end\n\n@implementation Service\n- (void)run {\n    [self helper];\n}\n@end\n\n@implementation Widget\n- (void)tick {\n    [self draw];\n}\n@end\n')
    assert kinds(out) == ["class:Service", "class:Widget", "protocol:Greeter"]
    assert (by["Service"].line, by["Service"].namespace, by["Service"].supertypes) == (8, "Service", ["NSObject", "Greeter"]) and "helper" in by["Service"].refs and "draw" in by["Widget"].refs
    assert sorted(i.raw for i in out.imports) == ["Foundation/Foundation.h", "Greeter.h"]


def test_lua_and_dart():
    out, by = read("lua", "src/app/client.lua", "\nlocal http = require(\"net.http\")\nlocal json = require 'json'\n\nfunction greet(who)\n  if who then return 1 end\n  return \"hi \" .. who\nend\n\nfunction M.fetch(url)\n  return http.get(url)\nend\n\nfunction Obj:run()\n  self:helper()\n  return json.encode({})\nend\n")
    assert kinds(out) == ["function:fetch", "function:greet", "function:run"] and by["greet"].line == 5 and by["fetch"].namespace == "app.client"
    assert "M.fetch" in by["fetch"].signature and "get" in by["fetch"].refs and {"helper", "encode"} <= set(by["run"].refs) and "get" not in by["greet"].refs
    assert sorted((i.raw, i.alias) for i in out.imports) == [("json", "json"), ("net.http", "http")]
    out, by = read("dart", "lib/data/repo.dart", "import 'package:flutter/material.dart';\nclass Repo extends Base implements Cache {\n  void load() {\n    var x = new Thing(1);\n  }\n}\nenum Color { red, green }\n\nint compute(int n) {\n  return n;\n}\n")
    assert kinds(out) == ["class:Repo", "enum:Color", "function:compute"]
    assert (by["Repo"].namespace, by["Repo"].supertypes, by["Repo"].method_count) == ("data.repo", ["Base", "Cache"], 1) and "Thing" in by["Repo"].refs
    assert (by["compute"].line, by["compute"].signature) == (9, "int compute(int n)")


@pytest.mark.parametrize("text", ['a // b"c\nd', "x /* {\n */ y", "s = \"{ // \" + '}'"])
def test_blanking_keeps_places(text):
    out = blanked(text)
    assert len(out) == len(text) and out.count("\n") == text.count("\n") and "{" not in out and "//" not in out
