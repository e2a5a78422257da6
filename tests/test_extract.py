import pytest

from lodestone.sources.extract import extractor
from lodestone.sources.parse import analyse, parse


def symbols(language, text):
    return extractor(language)(text).symbols


def test_python():
    got = symbols("python", '@lru_cache(maxsize=1)\ndef a(x: int = 1, *rest, k, **kw) -> str:\n    def inner(): ...\n\nclass B(Base, Generic[T], metaclass=M):\n    @property\n    def p(self): ...\n    def __q(self): ...\n    class C: pass\nif X:\n    async def d(): ...\n')
    assert [(s.name, s.kind, s.visibility, s.parent) for s in got] == [("a", "function", "public", None), ("B", "class", "public", None), ("p", "method", "public", "B"), ("__q", "method", "private", "B"), ("C", "class", "public", "B"), ("d", "function", "public", None)]
    assert got[0].signature == "def a(x: int = 1, *rest, k, **kw) -> str" and got[0].decorators == ["lru_cache(maxsize=1)"]
    assert got[1].implements == ["Base", "Generic[T]"] and got[1].line_end == 9


def test_python_that_does_not_parse():
    got = extractor("python")("import os\nclass A(B):\n    @x\n    def m(self):\n        def inner(): pass\n    def broken(:\n\ndef f() -> int:\n  return (\n")
    assert [(s.name, s.kind, s.parent) for s in got.symbols] == [("A", "class", None), ("m", "method", "A"), ("broken", "method", "A"), ("f", "function", None)]
    assert got.imports == ["import os"] and got.symbols[1].decorators == ["x"]


GO = '''package p
import ( "fmt"; "net/http" )
// type Hidden struct {}
type Store interface {
\tGet(id string) (*Item, error) // by id
\tio.Closer
}
type (
\tItem struct {
\t\tID string `json:"id" db:"id"`
\t}
\tAlias = map[string]int
)
func New[T any](f func(int) error) *Store { return nil }
func (s *Cache[T]) Get(id string) (*Item, error) { if x { } ; return nil, nil }
func hidden() {}
var s = "func Fake() {"
'''


def test_go():
    got = symbols("go", GO)
    assert [(s.name, s.kind, s.visibility, s.parent) for s in got] == [
        ("Store", "interface", "public", None), ("Get", "method", "public", "Store"), ("Item", "struct", "public", None), ("Alias", "class", "public", None),
        ("New", "function", "public", None), ("Get", "method", "public", "Cache"), ("hidden", "function", "private", None),
    ]
    assert got[1].signature == "Get(id string) (*Item, error)" and got[2].decorators == ["tags:db,json"]
    assert got[4].signature == "func New(f func(int) error)" and got[5].signature == "func (s *Cache[T]) Get(id string)"


TS = '''import { A } from "a"
/* class Hidden {} */
@Injectable()
export class Users<T> extends Base<T> implements IUsers, Other<T> {
  private readonly x = { a: 1, run() { return 1 } };
  constructor(private http: Http) { super(); if (a) { b() } }
  @Get(":id") one(id: string): Promise<{ a: number }> { return get(`x${id}`) }
  @Post() @Auth("x")
  protected async add<K>(k: K): Promise<void> { for (const a of b) { c(a) } }
  get size(): number { return 1 }
}
export abstract class Abs { abstract go(): void; }
interface Shape { area(): number }
export default function main(a: number, b = "(") : void { class Inner {} }
export const load = async (x: string): Promise<void> => { await y(x) }
const plain = compute(a)
export { plain as renamed }
'''


@pytest.mark.parametrize("language", ["typescript", "javascript"])
def test_typescript(language):
    got = extractor(language)(TS)
    assert [(s.name, s.kind, s.visibility, s.parent) for s in got.symbols] == [
        ("Users", "class", "public", None), ("constructor", "method", "public", "Users"), ("one", "method", "public", "Users"), ("add", "method", "protected", "Users"), ("size", "method", "public", "Users"),
        ("Abs", "class", "public", None), ("go", "method", "public", "Abs"), ("Shape", "interface", "public", None), ("main", "function", "public", None), ("load", "function", "public", None),
    ]
    users, _, one, add = got.symbols[:4]
    assert users.implements == ["IUsers", "Other<T>"] and users.decorators == ["Injectable()"] and users.signature == "class Users extends Base<T>"
    assert one.decorators == ['Get(":id")'] and one.signature == "one(id: string): Promise<{ a: number }>" and add.decorators == ["Post()", 'Auth("x")']
    assert got.exports == ["Users", "Abs", "main", "load", "renamed"]


CS = '''using System;
namespace A.B;
[ApiController, Route("api/[controller]")]
public class Orders : Base<int>, IOrders where T : new() {
  private readonly IRepo _repo, _other;
  public string Name { get; set; } = "x;{";
  public int Count => _list.Count;
  public Orders(IRepo repo) : base(repo) { if (a) { b(); } }
  [HttpGet("{id}")] public async Task<List<Order>> Get(int id, string s = "a,b") { return await x(); }
  void Hidden() => y();
  public enum Kind { One, Two }
}
interface IOrders { Task Save(Order o); }
internal struct Point { public int X; }
record Person(string Name, int Age);
'''


def test_csharp():
    got = symbols("c_sharp", CS)
    assert [(s.name, s.kind, s.visibility, s.parent) for s in got] == [
        ("Orders", "class", "public", None), ("_repo", "field", "private", "Orders"), ("Name", "property", "public", "Orders"), ("Count", "property", "public", "Orders"), ("Orders", "constructor", "public", "Orders"),
        ("Get", "method", "public", "Orders"), ("Hidden", "method", "private", "Orders"), ("Kind", "enum", "public", "Orders"), ("IOrders", "interface", "public", None), ("Save", "method", "public", "IOrders"),
        ("Point", "struct", "internal", None), ("X", "field", "public", "Point"), ("Person", "class", "internal", None),
    ]
    assert got[0].implements == ["Base<int>", "IOrders"] and got[0].decorators == ["ApiController", 'Route("api/[controller]")']
    assert got[4].signature == "public Orders(IRepo repo)" and got[5].decorators == ['HttpGet("{id}")']


@pytest.mark.parametrize("language", ["python", "go", "typescript", "c_sharp"])
@pytest.mark.parametrize("text", ["", "}}}) ((({{", "class", "type X struct {", "'unclosed \"", "func (", "@", "\x00\ufffd"])
def test_broken_texts_give_rows(language, text):
    assert analyse("p", language, text.encode())[0] == "p"


def test_parse_never_fails(spark):
    df = spark.createDataFrame([("a.py", "python", b"def f(): pass"), ("b.rb", "ruby", b"x"), ("c.py", "python", None), ("d.py", "python", b"\xff\xfe")], "path string, language string, content binary")
    got = {r["path"]: r for r in parse(df).collect()}
    assert got["a.py"]["symbols"][0]["name"] == "f" and got["a.py"]["error"] is None
    assert got["b.rb"]["error"] == "unsupported language" and got["c.py"]["error"] == "unreadable" and got["d.py"]["symbols"] == []
