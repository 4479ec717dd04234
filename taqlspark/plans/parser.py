"""Recursive-descent parser. Keywords and function names are case-insensitive, column names are not."""

from __future__ import annotations

from typing import Any

from ..types import TaqlError
from . import ast as A
from .lexer import Token, tokens

_CLAUSES = {"WHERE", "ORDERBY", "ORDER", "GROUPBY", "HAVING", "LIMIT", "OFFSET", "SET", "SELECT", "ADD", "DROP", "RENAME", "CREATE", "REMOVE", "DELETE", "INTO", "FROM"}


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.toks, self.i = text, tokens(text), 0

    # token helpers
    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def word(self, ahead: int = 0) -> str:
        t = self.toks[min(self.i + ahead, len(self.toks) - 1)]
        return t.text.upper() if t.kind == "name" else ""

    def take(self) -> Token:
        self.i += 1
        return self.toks[self.i - 1]

    def accept(self, *ops: str) -> str | None:
        if self.tok.kind == "op" and self.tok.text in ops:
            return self.take().text
        return None

    def accept_word(self, *words: str) -> str | None:
        w = self.word()
        if w and w in words:
            self.take()
            return w
        return None

    def expect(self, op: str) -> None:
        if not self.accept(op):
            raise TaqlError(f"expected {op!r} but found {self.tok.text or 'the end'!r} at {self.tok.at}")

    def expect_word(self, *words: str) -> str:
        found = self.accept_word(*words)
        if not found:
            raise TaqlError(f"expected {' or '.join(words)} but found {self.tok.text or 'the end'!r} at {self.tok.at}")
        return found

    def name(self) -> str:
        if self.tok.kind != "name":
            raise TaqlError(f"expected a name at {self.tok.at}")
        return self.take().text

    def done(self) -> None:
        self.accept(";")
        if self.tok.kind != "end":
            raise TaqlError(f"unexpected {self.tok.text!r} at {self.tok.at}")

    def integer(self) -> int:
        if self.tok.kind != "int":
            raise TaqlError(f"expected a whole number at {self.tok.at}")
        return int(self.take().value)  # type: ignore[call-overload]

    # statements
    def statement(self) -> Any:
        w = self.word()
        parse = {
            "SELECT": self.select, "COUNT": self.count, "CALC": self.calc, "UPDATE": self.update, "DELETE": self.delete,
            "INSERT": self.insert, "CREATE": self.create, "DROPTABLE": self.drop, "DROP": self.drop, "ALTER": self.alter,
            "SHOW": self.show, "HELP": self.show,
        }.get(w)
        if not parse:
            raise TaqlError(f"a statement can't begin with {self.tok.text!r}")
        found = parse()
        self.done()
        return found

    def table_ref(self) -> A.TableRef:
        if self.tok.kind == "dollar":
            return A.TableRef(position=int(self.take().value))  # type: ignore[call-overload]
        return A.TableRef(path=self.path())

    def path(self) -> str:
        if self.tok.kind == "str":
            return str(self.take().value)
        begin, end = self.tok.at, self.tok.at
        while self.tok.kind != "end" and self.tok.text not in (",", "[", "]", "(", ")", ";", "="):
            if self.word() in _CLAUSES and self.tok.at > end:
                break
            if self.tok.at > end and end > begin:
                break  # a path ends at white space
            end = self.tok.at + len(self.take().text)
        if end == begin:
            raise TaqlError(f"expected a table at {begin}")
        return self.text[begin:end]

    def select(self) -> A.Select:
        self.expect_word("SELECT")
        unique = bool(self.accept_word("UNIQUE", "DISTINCT"))
        items: list[A.Item] | None = None
        if self.word() in ("FROM", "INTO"):
            pass
        elif self.tok.text == "*" and self.tok.kind == "op":
            self.take()
        else:
            items = self.items()
        into = self.path() if self.accept_word("INTO") else None
        self.expect_word("FROM")
        out = A.Select(items, self.table_ref(), unique=unique, into=into)
        self.clauses(out, grouped=True)
        return out

    def items(self) -> list[A.Item]:
        out = []
        while True:
            expr = self.expr()
            alias = self.name() if self.accept_word("AS") else None
            out.append(A.Item(expr, alias))
            if not self.accept(","):
                return out

    def clauses(self, out: Any, grouped: bool = False) -> None:
        while True:
            w = self.word()
            if w == "WHERE" and out.where is None:
                self.take()
                out.where = self.expr()
            elif w == "ORDERBY" or w == "ORDER" and self.word(1) == "BY":
                self.i += 1 if w == "ORDERBY" else 2
                out.order = self.keys()
            elif grouped and w == "GROUPBY":
                self.take()
                out.group = [self.expr()]
                while self.accept(","):
                    out.group.append(self.expr())
            elif grouped and w == "HAVING":
                self.take()
                out.having = self.expr()
            elif w == "LIMIT":
                self.take()
                out.limit = self.integer()
            elif w == "OFFSET":
                self.take()
                out.offset = self.integer()
            else:
                return

    def keys(self) -> list[A.Key]:
        out = []
        while True:
            before = self.accept_word("ASC", "DESC")
            expr = self.expr()
            after = self.accept_word("ASC", "DESC")
            out.append(A.Key(expr, (after or before) == "DESC"))
            if not self.accept(","):
                return out

    def count(self) -> A.Count:
        self.expect_word("COUNT")
        if not self.accept("*"):
            while self.word() != "FROM":
                self.expr()
                if not self.accept(","):
                    break
        self.expect_word("FROM")
        out = A.Count(self.table_ref())
        if self.accept_word("WHERE"):
            out.where = self.expr()
        return out

    def calc(self) -> A.Calc:
        self.expect_word("CALC")
        items = self.items()
        self.expect_word("FROM")
        return A.Calc(items, self.table_ref())

    def update(self) -> A.Update:
        self.expect_word("UPDATE")
        table = self.table_ref()
        self.expect_word("SET")
        sets = []
        while True:
            column = self.name()
            self.expect("=")
            sets.append((column, self.expr()))
            if not self.accept(","):
                break
        out = A.Update(table, sets)
        self.clauses(out)
        return out

    def delete(self) -> A.Delete:
        self.expect_word("DELETE")
        self.expect_word("FROM")
        out = A.Delete(self.table_ref())
        self.clauses(out)
        return out

    def insert(self) -> A.Insert:
        self.expect_word("INSERT")
        self.expect_word("INTO")
        table, columns = self.table_ref(), None
        closing = {"(": ")", "[": "]"}.get(self.accept("(", "[") or "")
        if closing:
            columns = [self.name()]
            while self.accept(","):
                columns.append(self.name())
            self.expect(closing)
        if self.word() == "VALUES":
            raise TaqlError("INSERT takes rows from a SELECT only")
        return A.Insert(table, columns, self.select())

    def create(self) -> A.Create:
        self.expect_word("CREATE")
        self.expect_word("TABLE")
        path, columns = self.path(), []
        if self.accept("["):
            while not self.accept("]"):
                columns.append(self.column_spec())
                self.accept(",")
        keywords, rows = [], 0
        while self.word() in ("KEYWORDS", "LIMIT"):
            if self.accept_word("LIMIT"):
                rows = self.integer()
            else:
                self.take()
                keywords.append(self.keyword())
                while self.accept(","):
                    keywords.append(self.keyword())
        return A.Create(path, columns, keywords, rows)

    def keyword(self) -> tuple[str, Any]:
        key = self.name()
        self.expect("=")
        return key, self.constant()

    def constant(self) -> Any:
        minus = bool(self.accept("-"))
        if self.accept("["):
            out = []
            while not self.accept("]"):
                out.append(self.constant())
                self.accept(",")
            return out
        t = self.take()
        if t.kind == "name" and t.text.upper() in ("TRUE", "FALSE"):
            return t.text.upper() == "TRUE"
        if t.kind not in ("int", "float", "str"):
            raise TaqlError(f"expected a constant at {t.at}")
        return -t.value if minus else t.value  # type: ignore[operator]

    def column_spec(self) -> A.ColumnSpec:
        spec = A.ColumnSpec(self.name(), self.name())
        while self.word() in ("NDIM", "SHAPE", "OPTION", "OPTIONS", "MAXLEN", "COMMENT"):
            w = self.take().text.upper()
            self.expect("=")
            value = self.constant()
            if w == "NDIM":
                spec.ndim = int(value)
            elif w == "SHAPE":
                spec.shape = [int(x) for x in (value if isinstance(value, list) else [value])]
            elif w == "MAXLEN":
                spec.maxlen = int(value)
            elif w == "COMMENT":
                spec.comment = str(value)
            else:
                spec.options = int(value)
        return spec

    def drop(self) -> A.Drop:
        if self.take().text.upper() == "DROP":
            self.expect_word("TABLE")
        paths = [self.path()]
        while self.accept(","):
            paths.append(self.path())
        return A.Drop(paths)

    def alter(self) -> A.Alter:
        self.expect_word("ALTER")
        self.expect_word("TABLE")
        table, actions = self.table_ref(), []
        while self.tok.kind == "name":
            w = self.expect_word("ADD", "DROP", "RENAME", "SET", "CREATE", "REMOVE", "DELETE")
            if w == "ADD":
                self.accept_word("COLUMN")
                self.accept("[")
                actions.append(("add", self.column_spec()))
                while self._more():
                    actions.append(("add", self.column_spec()))
                self.accept("]")
            elif w == "DROP":
                self.accept_word("COLUMN")
                actions.append(("drop", self.name()))
                while self._more():
                    actions.append(("drop", self.name()))
            elif w == "RENAME":
                self.accept_word("COLUMN")
                old = self.name()
                if not self.accept_word("TO"):
                    self.expect("=")
                actions.append(("rename", old, self.name()))
            elif w in ("SET", "CREATE"):
                self.accept_word("KEYWORD")
                actions.append(("set", *self.keyword()))
            else:
                self.accept_word("KEYWORD")
                actions.append(("remove", self.name()))
            self.accept(",")
        if not actions:
            raise TaqlError("ALTER TABLE without an action")
        return A.Alter(table, actions)

    def _more(self) -> bool:
        """Whether a list of ALTER goes on: after a comma that no action follows."""
        follows = self.word(1) in ("ADD", "DROP", "RENAME", "SET", "CREATE", "REMOVE", "DELETE")
        return not follows and bool(self.accept(","))

    def show(self) -> A.Show:
        self.take()
        if self.accept_word("TABLE"):
            return A.Show(self.path())
        while self.tok.kind not in ("end",) and self.tok.text != ";":
            self.take()
        return A.Show()

    # expressions, loosest first
    def expr(self) -> Any:
        left = self.conjunction()
        while self.accept_word("OR") or self.accept("||", "|"):
            left = A.Binary("or", left, self.conjunction())
        return left

    def conjunction(self) -> Any:
        left = self.comparison()
        while self.accept_word("AND") or self.accept("&&", "&"):
            left = A.Binary("and", left, self.comparison())
        return left

    def comparison(self) -> Any:
        if self.accept_word("NOT"):
            return A.Unary("not", self.comparison())
        left = self.sum()
        negated = self.word() == "NOT" and self.word(1) in ("BETWEEN", "IN", "LIKE", "ILIKE")
        if negated:
            self.take()
        out: Any = None
        w = self.accept_word("BETWEEN", "IN", "LIKE", "ILIKE")
        if w == "BETWEEN":
            low = self.sum()
            self.expect_word("AND")
            out = A.Between(left, low, self.sum())
        elif w == "IN":
            opened = self.accept("(", "[")
            if not opened:
                raise TaqlError(f"expected a list at {self.tok.at}")
            if self.word() == "SELECT":
                raise TaqlError("IN takes a list of expressions, not a SELECT")
            close, items = ")" if opened == "(" else "]", []
            while not self.accept(close):
                items.append(self.expr())
                if not self.accept(","):
                    self.expect(close)
                    break
            out = A.In(left, items)
        elif w:
            out = A.Like(left, self.sum(), w == "ILIKE")
        if out is not None:
            return A.Unary("not", out) if negated else out
        op = self.accept("=", "==", "!=", "<>", "<", "<=", ">", ">=", "~", "!~")
        if op:
            return A.Binary({"==": "=", "<>": "!="}.get(op, op), left, self.sum())
        return left

    def sum(self) -> Any:
        left = self.product()
        while op := self.accept("+", "-"):
            left = A.Binary(op, left, self.product())
        return left

    def product(self) -> Any:
        left = self.unary()
        while op := self.accept("*", "/", "%"):
            left = A.Binary(op, left, self.unary())
        return left

    def unary(self) -> Any:
        if self.accept("-"):
            return A.Unary("-", self.unary())
        if self.accept("+"):
            return self.unary()
        if self.accept("!", "~") or self.accept_word("NOT"):
            return A.Unary("not", self.unary())
        return self.postfix()

    def postfix(self) -> Any:
        out = self.primary()
        while self.accept("["):
            out = A.Index(out, self.expr())
            self.expect("]")
        return out

    def primary(self) -> Any:
        t = self.tok
        if t.kind in ("int", "float", "str"):
            return A.Lit(self.take().value)
        if self.accept("("):
            out = self.expr()
            self.expect(")")
            return out
        if self.accept("["):
            if self.word() != "SELECT":
                items = []
                while not self.accept("]"):
                    items.append(self.expr())
                    if not self.accept(","):
                        self.expect("]")
                        break
                return A.Call("ARRAY", items)
            out = A.Subquery(self.select())
            self.expect("]")
            return out
        if t.kind == "name":
            word = t.text.upper()
            if self.toks[self.i + 1].text == "(" and self.toks[self.i + 1].kind == "op":
                self.i += 2
                args: list[Any] = []
                while not self.accept(")"):
                    args.append(self.expr())
                    if not self.accept(","):
                        self.expect(")")
                        break
                return A.Call(word, args)
            self.take()
            if word in ("TRUE", "FALSE"):
                return A.Lit(word == "TRUE")
            if word == "ROWID":
                return A.Call("ROWID", [])
            return A.Name(t.text)
        raise TaqlError(f"unexpected {t.text or 'end'!r} at {t.at}")


def parse(text: str) -> Any:
    """A statement."""
    return Parser(text).statement()


def parse_expression(text: str) -> Any:
    p = Parser(text)
    out = p.expr()
    p.done()
    return out
