"""Small sources with what the extractors read from them, written down once and read
against the sources."""

SOURCES = (
    ("web/user.ts", """import { store } from './store';
export * from "../shared";
// Greets.
export function greet(name: string): string { return format(name); }
const twice = (x: number) => x + x;
export class User extends Base implements Named {
  private id: number;
  save(): void { store("{ no brace }"); }
}
interface Named { name: string }
enum Color { Red, Green }
type Alias = string;
const limit = 3;
"""),
    ("app/models.py", """import os
from .base import Model
class User(Model):
    def save(self, force=False):
        check(force)
        return os.getcwd()
def main():
    User().save()
LIMIT = 3
"""),
    ("pkg/main.go", """package main
import (
  "fmt"
  "os"
)
const (
  Low = iota
  Mid, High = 1, 2
)
var a, b int
type User struct {
  X, Y int
  Name string
}
type Saver interface { Save() }
func (u *User) Save() error { return nil }
func main() { fmt.Println(load("x")) }
"""),
    ("src/lib.rs", """use std::fmt;
pub struct User {
    pub name: String,
}
enum Shape {
    Circle(f64),
    Square { side: f64 },
}
trait Save {
    fn save(&self);
}
impl Save for User {
    fn save(&self) {
        write(self)
    }
}
mod inner {
    pub fn f() {}
}
fn main() {
    run();
}
"""),
    ("com/x/User.java", """package com.x;
import java.util.List;
/** A user. */
public class User extends Base implements Named {
  private int id, age;
  static { init(); }
  public User(int id) { this.id = id; }
  List<String> names() { return load(x -> x.trim()); }
  enum Kind { A, B }
}
record Point(int x, int y) {}
"""),
    ("geo/shape.cpp", """#include <vector>
#include "own.h"
#define LIMIT 3
namespace app {
class Shape : public Base {
 public:
  double area() const { return size(1); }
 private:
  int w, h;
};
enum class Color { Red, Green };
}
int main() { auto f = [](int x) { return g(x); }; return f(1); }
"""),
    ("App/Main.cs", "class Main { }\n"),
    ("notes.txt", "def not_code(): pass\n"),
)

_TYPESCRIPT = """
('function', 'greet', 'web/user/greet', 3),
('function', 'twice', 'web/user/twice', 4),
('class', 'User', 'web/user/User', 5),
('extends', 'web/user/User', 'Base', -1),
('implements', 'web/user/User', 'Named', -1),
('method', 'save', 'web/user/save', 7),
('contains', 'web/user/User', 'web/user/save', -1),
('interface', 'Named', 'web/user/Named', 9),
('enum', 'Color', 'web/user/Color', 10),
('type', 'Alias', 'web/user/Alias', 11),
('variable', 'limit', 'web/user/limit', 12),
('imports', '', 'web/./store.ts', -1),
('imports', '', 'web/../shared.ts', -1),
('call', 'format', '', 3),
('call', 'store', '', 7)
"""

_PYTHON = """
('imports', '', 'os.py', -1),
('imports', '', 'base.py', -1),
('class', 'User', 'app.models.User', 2),
('extends', 'app.models.User', 'Model', -1),
('method', 'save', 'app.models.save', 3),
('contains', 'app.models.User', 'app.models.save', -1),
('function', 'main', 'app.models.main', 6),
('variable', 'LIMIT', 'app.models.LIMIT', 8),
('call', 'save', '', 7),
('call', 'check', '', 4),
('call', 'getcwd', '', 5),
('call', 'User', '', 7)
"""

_GO = """
('class', 'User', 'pkg.User', 10),
('field', 'Name', 'pkg.Name', 12),
('contains', 'pkg.User', 'pkg.Name', -1),
('interface', 'Saver', 'pkg.Saver', 14),
('method', 'Save', 'pkg.Save', 15),
('contains', 'pkg.User', 'pkg.Save', -1),
('function', 'main', 'pkg.main', 16),
('constant', 'Low', 'pkg.Low', 6),
('constant', 'Mid', 'pkg.Mid', 7),
('constant', 'High', 'pkg.High', 7),
('variable', 'a', 'pkg.a', 9),
('variable', 'b', 'pkg.b', 9),
('field', 'X', 'pkg.X', 11),
('contains', 'pkg.User', 'pkg.X', -1),
('field', 'Y', 'pkg.Y', 11),
('contains', 'pkg.User', 'pkg.Y', -1),
('imports', '', 'fmt', -1),
('imports', '', 'os', -1),
('call', 'Save', '', 14),
('call', 'Println', '', 16),
('call', 'load', '', 16)
"""

_RUST = """
('struct', 'User', 'User', 1),
('field', 'name', 'User::name', 2),
('contains', 'User', 'User::name', -1),
('enum', 'Shape', 'Shape', 4),
('trait', 'Save', 'Save', 8),
('method', 'save', 'Save::save', 9),
('contains', 'Save', 'Save::save', -1),
('method', 'save', 'User::save', 12),
('module', 'inner', 'inner', 16),
('function', 'f', 'inner::f', 17),
('contains', 'inner', 'inner::f', -1),
('function', 'main', 'main', 19),
('enum', 'Circle', 'Shape::Circle', 5),
('contains', 'Shape', 'Shape::Circle', -1),
('enum', 'Square', 'Shape::Square', 6),
('contains', 'Shape', 'Shape::Square', -1),
('implements', 'User', 'Save', -1),
('imports', '', 'std::fmt', -1),
('call', 'write', '', 13),
('calls', 'src/lib.rs#root', 'write', -1),
('call', 'run', '', 20),
('calls', 'src/lib.rs#root', 'run', -1)
"""

_JAVA = """
('class', 'User', 'com.x.User', 3),
('extends', 'com.x.User', 'Base', -1),
('implements', 'com.x.User', 'Named', -1),
('field', 'age', 'com.x.User.age', 4),
('contains', 'com.x.User', 'com.x.User.age', -1),
('method', 'User', 'com.x.User.User', 6),
('contains', 'com.x.User', 'com.x.User.User', -1),
('method', 'names', 'com.x.User.names', 7),
('contains', 'com.x.User', 'com.x.User.names', -1),
('enum', 'Kind', 'com.x.User.Kind', 8),
('contains', 'com.x.User', 'com.x.User.Kind', -1),
('class', 'Point', 'com.x.Point', 10),
('field', 'id', 'com.x.User.id', 4),
('contains', 'com.x.User', 'com.x.User.id', -1),
('method', '<clinit>', 'com.x.User.static_init_5', 5),
('contains', 'com.x.User', 'com.x.User.static_init_5', -1),
('function', 'lambda_7', 'com.x.User.lambda_7', 7),
('contains', 'com.x.User.names', 'com.x.User.lambda_7', -1),
('enum_member', 'A', 'com.x.User.Kind.A', 8),
('contains', 'com.x.User.Kind', 'com.x.User.Kind.A', -1),
('enum_member', 'B', 'com.x.User.Kind.B', 8),
('contains', 'com.x.User.Kind', 'com.x.User.Kind.B', -1),
('method', 'Point', 'com.x.Point.Point', 10),
('contains', 'com.x.Point', 'com.x.Point.Point', -1),
('imports', '', 'java.util.List', -1),
('call', 'init', '', 5),
('calls', 'com/x/User.java#root', 'init', -1),
('call', 'load', '', 7),
('calls', 'com/x/User.java#root', 'load', -1),
('call', 'trim', '', 7),
('calls', 'com/x/User.java#root', 'trim', -1)
"""

_CPP = """
('constant', 'LIMIT', 'LIMIT', 2),
('namespace', 'app', 'app', 3),
('class', 'Shape', 'app::Shape', 4),
('contains', 'app', 'app::Shape', -1),
('extends', 'app::Shape', 'Base', -1),
('method', 'area', 'app::Shape::area', 6),
('contains', 'app::Shape', 'app::Shape::area', -1),
('field', 'h', 'app::Shape::h', 8),
('contains', 'app::Shape', 'app::Shape::h', -1),
('enum', 'Color', 'app::Color', 10),
('contains', 'app', 'app::Color', -1),
('function', 'main', 'main', 12),
('field', 'w', 'app::Shape::w', 8),
('contains', 'app::Shape', 'app::Shape::w', -1),
('enum_member', 'Red', 'app::Color.Red', 10),
('contains', 'app::Color', 'app::Color.Red', -1),
('enum_member', 'Green', 'app::Color.Green', 10),
('contains', 'app::Color', 'app::Color.Green', -1),
('function', 'lambda_12_22', 'lambda_12_22', 12),
('contains', 'main', 'lambda_12_22', -1),
('imports', '', 'vector', -1),
('imports', '', 'own.h', -1),
('call', 'size', '', 6),
('calls', 'app::Shape::area', 'size', -1),
('call', 'g', '', 12),
('calls', 'main', 'g', -1),
('call', 'f', '', 12),
('calls', 'main', 'f', -1)
"""

_CSHARP = """
('module', 'Main.cs', 'App/Main.cs', 0)
"""

FACTS = {"ts": _TYPESCRIPT, "py": _PYTHON, "go": _GO, "rs": _RUST, "java": _JAVA, "cpp": _CPP, "cs": _CSHARP}
