"""Edits of flattening by syntax trees: members of contracts, names of imported files, @inheritdoc, abicoder."""

import json

from buildlens.operators import ast, edits

A = """pragma abicoder v2;
import "./B.sol" as X;
contract P {
  /// é @inheritdoc Base
  function f(Base.S s, X.P.T t) public { X.P p; X.free(); }
  /// @inheritdoc X.Base
  function g() public {}
}
"""
B = "pragma experimental ABIEncoderV2;\ncontract P { struct T { T2 u; } struct T2 { int i; } }\ncontract Base { struct S { int i; } }\nfunction free() {}\n"


def src(text, part, nth=0, size=None):
    at = -1
    for _ in range(nth + 1):
        at = text.index(part, at + 1)
    return f"{len(text[:at].encode())}:{len((part if size is None else text[at:at + size]).encode())}:0"


def node(kind, i, where, **more):
    return {"nodeType": kind, "id": i, "src": where, **more}


def test_flatten_with_trees_edits_members_qualifiers_docs_and_pragmas(spark):
    path = lambda i, text, to: node("UserDefinedTypeName", i, src(A, text), pathNode=node("IdentifierPath", i + 1, src(A, text), referencedDeclaration=to), referencedDeclaration=to)
    doc1, doc2 = "/// é @inheritdoc Base", "/// @inheritdoc X.Base"
    f = node("FunctionDefinition", 10, src(A, "function f"), name="f", documentation=node("StructuredDocumentation", 11, src(A, doc1)), nodes=[
        path(12, "Base.S", 41), path(14, "X.P.T", 32), path(16, "X.P p", 31) | {"src": src(A, "X.P p", size=3), "pathNode": node("IdentifierPath", 17, src(A, "X.P p", size=3), referencedDeclaration=31)},
        node("MemberAccess", 18, src(A, "X.free"), memberName="free", referencedDeclaration=50, expression=node("Identifier", 19, src(A, "X.free", size=1), name="X", referencedDeclaration=3)),
    ])
    g = node("FunctionDefinition", 20, src(A, "function g"), name="g", documentation=node("StructuredDocumentation", 21, src(A, doc2)))
    a = node("SourceUnit", 1, f"0:{len(A.encode())}:0", exportedSymbols={"P": [4], "Base": [40]}, nodes=[node("PragmaDirective", 2, src(A, "pragma abicoder v2;"), literals=["abicoder", "v2"]), node("ImportDirective", 3, src(A, 'import "./B.sol" as X;')), node("ContractDefinition", 4, src(A, "contract P"), name="P", nodes=[f, g])])
    u = node("UserDefinedTypeName", 35, src(B, "T2 u", size=2), referencedDeclaration=34)
    p = node("ContractDefinition", 31, src(B, "contract P"), name="P", nodes=[node("StructDefinition", 32, src(B, "struct T "), name="T", members=[u]), node("StructDefinition", 34, src(B, "struct T2"), name="T2")])
    base = node("ContractDefinition", 40, src(B, "contract Base"), name="Base", nodes=[node("StructDefinition", 41, src(B, "struct S"), name="S")])
    b = node("SourceUnit", 30, f"0:{len(B)}:1", nodes=[node("PragmaDirective", 36, src(B, "pragma experimental ABIEncoderV2;"), literals=["experimental", "ABIEncoderV2"]), p, base, node("FunctionDefinition", 50, src(B, "function free"), name="free")])
    s = spark.createDataFrame([("A.sol", A), ("B.sol", B)], "path string, content string")
    nodes = ast.walk(spark.createDataFrame([("A.sol", json.dumps(a)), ("B.sol", json.dumps(b))], "path string, ast string"))
    edges = spark.createDataFrame([("A.sol", "B.sol")], "src string, dst string")
    text = edits.flatten_with_trees(s, nodes, edges, "A.sol").first()["content"]
    assert text.startswith("pragma abicoder v2;\n") and text.count("pragma") == 1
    assert "contract P_0 { struct T { T2 u; } struct T2 { int i; } }" in text
    assert "  /// é @inheritdoc Base\n  function f(Base.S s, P_0.T t) public { P_0 p; free(); }\n  /// \n  function g() public {}" in text
    assert "X." not in text
