"""DuckDB SQL of the code queries: the rows that every supplier's scripts and scene give.

Most were taken from the operators' output and read through by hand, so they pin results.

``{k}`` in a text stands for the supplier's key and ``{b}`` for the one before it.
"""

from __future__ import annotations

from quarry.sources import generated

_SCENES = f"WHERE s_suppkey % {generated.TURNS} = {generated._place(generated.FINDINGS, 'GD4011')}"

_BASE = "CASE WHEN s_suppkey % 5 = 0 THEN 'RefCounted' ELSE 'S'||(s_suppkey-1) END"


def _text(value: str) -> str:
    return f"replace(replace(replace({value}, '{{k}}', s_suppkey::VARCHAR), '{{b}}', (s_suppkey-1)::VARCHAR), '{{base}}', {_BASE})"


def _rows(columns: str, rows: str, scenes: bool = False) -> str:
    """SQL of typed rows for every supplier, or for those with a scene."""
    named = [c.split() for c in columns.split(", ")]
    out = ", ".join(f"{_text(f'c{i}::VARCHAR')} AS {c}" if t == "VARCHAR" else f"c{i}::{t} AS {c}" for i, (c, t) in enumerate(named))
    heads = ", ".join(f"c{i}" for i in range(len(named)))
    return f"SELECT {out} FROM supplier, (VALUES {rows.strip()}) AS v({heads}) {_SCENES if scenes else ''}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EDGES = f"""
SELECT 's/'||s_suppkey||'.gd' AS src, 's/'||(s_suppkey-1)||'.gd' AS dst, 'extends' AS kind FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'r/'||s_suppkey||'.gd', 's/'||s_suppkey||'.gd', 'preload' FROM supplier
UNION ALL SELECT 'GD4011/'||s_suppkey||'.tscn', 'GD4011/'||s_suppkey||'.gd', 'scene' FROM supplier {_SCENES}
UNION ALL SELECT 'GD4011/'||s_suppkey||'.tscn', 'GD4011/gone_'||s_suppkey||'.tscn', 'scene' FROM supplier {_SCENES}
"""

ORACLES: dict[str, str] = {
    "code_inheritance": "SELECT 's/'||a.s_suppkey||'.gd' AS path, 's/'||b.s_suppkey||'.gd' AS ancestor_path, (a.s_suppkey-b.s_suppkey)::INT AS depth FROM supplier a JOIN supplier b ON a.s_suppkey // 5 = b.s_suppkey // 5 AND a.s_suppkey > b.s_suppkey",
    "code_dependencies": _EDGES,
    "code_dependency_report": f"""
        WITH RECURSIVE e AS ({_EDGES}), reach(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)
        SELECT path, count(DISTINCT o.dst) AS fan_out, (SELECT count(*) FROM reach WHERE reach.dst = path) AS fan_in, false AS in_cycle
        FROM (SELECT src AS path FROM e UNION SELECT dst FROM e) LEFT JOIN e o ON o.src = path GROUP BY path
    """,
    "code_project_metrics": "SELECT (2*n)::BIGINT AS files, (78*n)::BIGINT AS lines, (53*n)::BIGINT AS code, (10*n)::BIGINT AS methods, 1.7::DOUBLE AS avg_cyclomatic, 83.118144::DOUBLE AS \"index\" FROM (SELECT count(*) AS n FROM supplier)",
    "code_formatted": f"SELECT 's/'||s_suppkey||'.gd' AS path, replace(replace({_quoted(generated.OWN)}, '{{k}}', s_suppkey::VARCHAR), '{{base}}', {_BASE}) AS text FROM supplier UNION ALL SELECT 'r/'||s_suppkey||'.gd', replace({_quoted(generated.RISKY)}, '{{k}}', s_suppkey::VARCHAR) FROM supplier",
    "code_ast_nodes": _rows(
        "path VARCHAR, node_id INT, parent_id INT, kind VARCHAR, name VARCHAR, start_line INT, end_line INT, depth INT",
        """
        ('r/{k}.gd', 0, -1, 'file', NULL, 1, 38, 0),
        ('r/{k}.gd', 1, 0, 'extends', 'Node', 1, 1, 0),
        ('r/{k}.gd', 10, 4, 'expr', NULL, 13, 13, 0),
        ('r/{k}.gd', 11, 4, 'expr', NULL, 14, 14, 0),
        ('r/{k}.gd', 12, 0, 'func', 'on_ready', 17, 19, 0),
        ('r/{k}.gd', 13, 12, 'var', 'file', 18, 18, 0),
        ('r/{k}.gd', 14, 12, 'return', NULL, 19, 19, 0),
        ('r/{k}.gd', 15, 0, 'func', 'greet', 22, 24, 0),
        ('r/{k}.gd', 16, 15, 'var', 'size', 23, 23, 0),
        ('r/{k}.gd', 17, 15, 'expr', NULL, 24, 24, 0),
        ('r/{k}.gd', 18, 0, 'func', 'measure', 27, 31, 0),
        ('r/{k}.gd', 19, 18, 'if', NULL, 28, 29, 0),
        ('r/{k}.gd', 2, 0, 'const', 'Other', 3, 3, 0),
        ('r/{k}.gd', 20, 19, 'expr', NULL, 29, 29, 1),
        ('r/{k}.gd', 21, 18, 'return', NULL, 30, 30, 0),
        ('r/{k}.gd', 22, 18, 'assign', 'thing', 31, 31, 0),
        ('r/{k}.gd', 23, 0, 'func', 'spare', 34, 37, 0),
        ('r/{k}.gd', 24, 23, 'var', 'nothing', 35, 35, 0),
        ('r/{k}.gd', 25, 23, 'var', 'near', 36, 36, 0),
        ('r/{k}.gd', 26, 23, 'expr', NULL, 37, 37, 0),
        ('r/{k}.gd', 3, 0, 'var', 'target', 4, 4, 0),
        ('r/{k}.gd', 4, 0, 'func', '_ready', 7, 14, 0),
        ('r/{k}.gd', 5, 4, 'expr', NULL, 8, 8, 0),
        ('r/{k}.gd', 6, 4, 'expr', NULL, 9, 9, 0),
        ('r/{k}.gd', 7, 4, 'expr', NULL, 10, 10, 0),
        ('r/{k}.gd', 8, 4, 'if', NULL, 11, 12, 0),
        ('r/{k}.gd', 9, 8, 'expr', NULL, 12, 12, 1),
        ('s/{k}.gd', 0, -1, 'file', NULL, 1, 40, 0),
        ('s/{k}.gd', 1, 0, 'class_name', 'S{k}', 1, 1, 0),
        ('s/{k}.gd', 10, 0, 'var', 'balance', 8, 8, 0),
        ('s/{k}.gd', 11, 0, 'var', '_later', 9, 9, 0),
        ('s/{k}.gd', 12, 0, 'var', '_count', 10, 10, 0),
        ('s/{k}.gd', 13, 0, 'var', '_unread', 11, 11, 0),
        ('s/{k}.gd', 14, 0, 'func', '_ready', 14, 18, 0),
        ('s/{k}.gd', 15, 14, 'assign', '_count', 15, 15, 0),
        ('s/{k}.gd', 16, 14, 'expr', NULL, 16, 16, 0),
        ('s/{k}.gd', 17, 14, 'expr', NULL, 17, 17, 0),
        ('s/{k}.gd', 18, 14, 'expr', NULL, 18, 18, 0),
        ('s/{k}.gd', 19, 0, 'func', 'base_{k}', 21, 22, 0),
        ('s/{k}.gd', 2, 0, 'extends', '{base}', 2, 2, 0),
        ('s/{k}.gd', 20, 19, 'return', NULL, 22, 22, 0),
        ('s/{k}.gd', 21, 0, 'func', 'make', 25, 26, 0),
        ('s/{k}.gd', 22, 21, 'return', NULL, 26, 26, 0),
        ('s/{k}.gd', 23, 0, 'func', '_used', 29, 35, 0),
        ('s/{k}.gd', 24, 23, 'for', 'i', 30, 35, 0),
        ('s/{k}.gd', 25, 24, 'if', NULL, 31, 32, 1),
        ('s/{k}.gd', 26, 25, 'expr', NULL, 32, 32, 2),
        ('s/{k}.gd', 27, 24, 'elif', NULL, 33, 35, 1),
        ('s/{k}.gd', 28, 27, 'expr', NULL, 35, 35, 2),
        ('s/{k}.gd', 29, 0, 'func', '_unused', 38, 39, 0),
        ('s/{k}.gd', 3, 0, 'signal', 'paid', 4, 4, 0),
        ('s/{k}.gd', 30, 29, 'pass', NULL, 39, 39, 0),
        ('s/{k}.gd', 4, 0, 'signal', 'never_{k}', 5, 5, 0),
        ('s/{k}.gd', 5, 0, 'enum', 'State', 6, 6, 0),
        ('s/{k}.gd', 6, 5, 'enum_value', 'IDLE', 6, 6, 1),
        ('s/{k}.gd', 7, 5, 'enum_value', 'BUSY', 6, 6, 1),
        ('s/{k}.gd', 8, 5, 'enum_value', 'LOST', 6, 6, 1),
        ('s/{k}.gd', 9, 0, 'const', 'LIMIT', 7, 7, 0)
        """,
        scenes=False,
    ),
    "code_symbols": _rows(
        "path VARCHAR, kind VARCHAR, name VARCHAR, type_name VARCHAR, is_static BOOLEAN, is_public BOOLEAN, line INT",
        """
        ('r/{k}.gd', 'const', 'Other', NULL, false, true, 3),
        ('r/{k}.gd', 'func', '_ready', NULL, false, false, 7),
        ('r/{k}.gd', 'func', 'greet', NULL, false, true, 22),
        ('r/{k}.gd', 'func', 'measure', NULL, false, true, 27),
        ('r/{k}.gd', 'func', 'on_ready', NULL, false, true, 17),
        ('r/{k}.gd', 'func', 'spare', NULL, false, true, 34),
        ('r/{k}.gd', 'local', 'file', NULL, false, true, 18),
        ('r/{k}.gd', 'local', 'near', NULL, false, true, 36),
        ('r/{k}.gd', 'local', 'nothing', NULL, false, true, 35),
        ('r/{k}.gd', 'local', 'size', 'int', false, true, 23),
        ('r/{k}.gd', 'param', 'thing', NULL, false, true, 27),
        ('r/{k}.gd', 'param', 'who', NULL, false, true, 22),
        ('r/{k}.gd', 'var', 'target', 'Node2D', false, true, 4),
        ('s/{k}.gd', 'const', 'LIMIT', NULL, false, true, 7),
        ('s/{k}.gd', 'enum', 'State', NULL, false, true, 6),
        ('s/{k}.gd', 'enum_value', 'BUSY', NULL, false, true, 6),
        ('s/{k}.gd', 'enum_value', 'IDLE', NULL, false, true, 6),
        ('s/{k}.gd', 'enum_value', 'LOST', NULL, false, true, 6),
        ('s/{k}.gd', 'func', '_ready', 'void', false, false, 14),
        ('s/{k}.gd', 'func', '_unused', 'void', false, false, 38),
        ('s/{k}.gd', 'func', '_used', 'void', false, false, 29),
        ('s/{k}.gd', 'func', 'base_{k}', 'int', false, true, 21),
        ('s/{k}.gd', 'func', 'make', 'int', true, true, 25),
        ('s/{k}.gd', 'iterator', 'i', NULL, false, true, 30),
        ('s/{k}.gd', 'param', 'amount', 'int', false, true, 29),
        ('s/{k}.gd', 'param', 'given', NULL, false, true, 25),
        ('s/{k}.gd', 'param', 'spare', NULL, false, true, 38),
        ('s/{k}.gd', 'signal', 'never_{k}', NULL, false, true, 5),
        ('s/{k}.gd', 'signal', 'paid', NULL, false, true, 4),
        ('s/{k}.gd', 'var', '_count', NULL, false, false, 10),
        ('s/{k}.gd', 'var', '_later', NULL, false, false, 9),
        ('s/{k}.gd', 'var', '_unread', NULL, false, false, 11),
        ('s/{k}.gd', 'var', 'balance', 'float', false, true, 8)
        """,
        scenes=False,
    ),
    "code_list_public_functions": _rows(
        "path VARCHAR, name VARCHAR, line INT",
        """
        ('r/{k}.gd', 'greet', 22),
        ('r/{k}.gd', 'measure', 27),
        ('r/{k}.gd', 'on_ready', 17),
        ('r/{k}.gd', 'spare', 34),
        ('s/{k}.gd', 'base_{k}', 21),
        ('s/{k}.gd', 'make', 25)
        """,
        scenes=False,
    ),
    "code_list_exports": _rows(
        "path VARCHAR, name VARCHAR, type_name VARCHAR",
        """
        ('s/{k}.gd', 'balance', 'float')
        """,
        scenes=False,
    ),
    "code_method_metrics": _rows(
        "path VARCHAR, method VARCHAR, start_line INT, parameters BIGINT, loc BIGINT, cyclomatic BIGINT, cognitive BIGINT, nesting BIGINT, locals BIGINT, returns BIGINT, maintainability DOUBLE",
        """
        ('r/{k}.gd', '_ready', 7, 0, 8, 2, 1, 1, 0, 0, 71.521657),
        ('r/{k}.gd', 'greet', 22, 1, 3, 1, 0, 0, 1, 0, 85.871139),
        ('r/{k}.gd', 'measure', 27, 1, 5, 3, 2, 1, 0, 1, 78.048203),
        ('r/{k}.gd', 'on_ready', 17, 0, 3, 1, 0, 0, 1, 1, 85.871139),
        ('r/{k}.gd', 'spare', 34, 0, 4, 1, 0, 0, 2, 0, 81.563627),
        ('s/{k}.gd', '_ready', 14, 0, 5, 1, 0, 0, 0, 0, 78.317209),
        ('s/{k}.gd', '_unused', 38, 1, 2, 1, 0, 0, 0, 0, 92.345917),
        ('s/{k}.gd', '_used', 29, 1, 7, 5, 5, 2, 0, 0, 72.950718),
        ('s/{k}.gd', 'base_{k}', 21, 0, 2, 1, 0, 0, 0, 1, 92.345917),
        ('s/{k}.gd', 'make', 25, 1, 2, 1, 0, 0, 0, 1, 92.345917)
        """,
        scenes=False,
    ),
    "code_file_metrics": _rows(
        "path VARCHAR, total BIGINT, blank BIGINT, comment BIGINT, code BIGINT, methods BIGINT, avg_cyclomatic DOUBLE, max_cyclomatic BIGINT, max_nesting BIGINT, index DOUBLE",
        """
        ('r/{k}.gd', 38, 11, 1, 26, 5, 1.6, 3, 1, 80.575153),
        ('s/{k}.gd', 40, 12, 1, 27, 5, 1.8, 5, 2, 85.661136)
        """,
        scenes=False,
    ),
    "code_type_coverage": _rows(
        "path VARCHAR, annotated BIGINT, inferred BIGINT, untyped BIGINT, annotated_share DOUBLE, typed_share DOUBLE",
        """
        ('r/{k}.gd', 2, 3, 2, 28.571429, 71.428571),
        ('s/{k}.gd', 2, 4, 2, 25.0, 75.0)
        """,
        scenes=False,
    ),
    "code_missing_resources": _rows(
        "path VARCHAR, target VARCHAR, type VARCHAR",
        """
        ('GD4011/{k}.tscn', 'res://GD4011/{k}.gd', 'Script'),
        ('GD4011/{k}.tscn', 'res://GD4011/gone_{k}.tscn', 'PackedScene')
        """,
        scenes=True,
    ),
    "code_call_sites": _rows(
        "path VARCHAR, caller VARCHAR, target_class VARCHAR, target VARCHAR, line INT, col INT, receiver VARCHAR",
        """
        ('r/{k}.gd', '_ready', '*', 'connect', 8, 12, 'ready'),
        ('r/{k}.gd', '_ready', '*', 'execute', 9, 4, 'OS'),
        ('r/{k}.gd', '_ready', '{k}', 'greet', 13, 1, NULL),
        ('r/{k}.gd', '_ready', '{k}', 'greet', 14, 1, NULL),
        ('r/{k}.gd', '_ready', 'node2d', 'hide', 12, 9, 'target'),
        ('r/{k}.gd', '_ready', 'node2d', 'show', 10, 8, 'target'),
        ('r/{k}.gd', 'greet', '{k}', 'print', 24, 1, NULL),
        ('r/{k}.gd', 'measure', '*', 'has_method', 28, 28, 'thing'),
        ('r/{k}.gd', 'measure', '*', 'step', 29, 8, 'thing'),
        ('r/{k}.gd', 'on_ready', '{k}', 'load', 18, 12, NULL),
        ('r/{k}.gd', 'spare', '*', 'step', 37, 6, 'near'),
        ('r/{k}.gd', NULL, '{k}', 'preload', 3, 14, NULL),
        ('s/{k}.gd', '_ready', '*', 'emit', 16, 6, 'paid'),
        ('s/{k}.gd', '_ready', 's{k}', '_used', 18, 1, NULL),
        ('s/{k}.gd', '_ready', 's{k}', 'print', 17, 1, NULL),
        ('s/{k}.gd', '_used', 's{k}', 'make', 35, 9, NULL),
        ('s/{k}.gd', '_used', 's{k}', 'print', 32, 3, NULL),
        ('s/{k}.gd', '_used', 's{k}', 'print', 35, 3, NULL),
        ('s/{k}.gd', '_used', 's{k}', 'range', 30, 10, NULL)
        """,
        scenes=False,
    ),
    "code_dead_code": _rows(
        "path VARCHAR, kind VARCHAR, name VARCHAR, line INT, col INT, reason VARCHAR, confidence VARCHAR",
        """
        ('r/{k}.gd', 'const', 'Other', 3, 6, 'CNU', 'Strict'),
        ('r/{k}.gd', 'func', 'measure', 27, 5, 'FNC', 'Strict'),
        ('r/{k}.gd', 'func', 'spare', 34, 5, 'FNC', 'Strict'),
        ('r/{k}.gd', 'local', 'nothing', 35, 5, 'VNR', 'Strict'),
        ('s/{k}.gd', 'enum_value', 'LOST', 6, 25, 'ENU', 'Potential'),
        ('s/{k}.gd', 'func', '_unused', 38, 5, 'FNC', 'Strict'),
        ('s/{k}.gd', 'func', 'base_{k}', 21, 5, 'FPA', 'Potential'),
        ('s/{k}.gd', 'param', 'spare', 38, 5, 'PNU', 'Strict'),
        ('s/{k}.gd', 'signal', 'never_{k}', 5, 7, 'FPA', 'Potential'),
        ('s/{k}.gd', 'var', '_later', 9, 13, 'VOR', 'Potential'),
        ('s/{k}.gd', 'var', '_unread', 11, 4, 'VNR', 'Strict')
        """,
        scenes=False,
    ),
    "code_unreachable": _rows(
        "path VARCHAR, line INT, kind VARCHAR",
        """
        ('r/{k}.gd', 31, 'assign')
        """,
        scenes=False,
    ),
    "code_lint": _rows(
        "path VARCHAR, line INT, rule VARCHAR, name VARCHAR",
        """
        ('r/{k}.gd', 24, 'GDL238', 'no-debug-print'),
        ('r/{k}.gd', 3, 'GDL004', 'constant-name-case'),
        ('r/{k}.gd', 31, 'GDL210', 'dead-code'),
        ('r/{k}.gd', 35, 'GDL201', 'unused-variable'),
        ('s/{k}.gd', 10, 'GDL301', 'member-ordering'),
        ('s/{k}.gd', 11, 'GDL301', 'member-ordering'),
        ('s/{k}.gd', 17, 'GDL238', 'no-debug-print'),
        ('s/{k}.gd', 32, 'GDL238', 'no-debug-print'),
        ('s/{k}.gd', 35, 'GDL238', 'no-debug-print'),
        ('s/{k}.gd', 38, 'GDL202', 'unused-parameter'),
        ('s/{k}.gd', 38, 'GDL203', 'empty-function'),
        ('s/{k}.gd', 38, 'GDL252', 'unused-function'),
        ('s/{k}.gd', 5, 'GDL207', 'unused-signal')
        """,
        scenes=False,
    ),
    "code_lint_unsuppressed": _rows(
        "path VARCHAR, line INT, rule VARCHAR, name VARCHAR",
        """
        ('r/{k}.gd', 24, 'GDL238', 'no-debug-print'),
        ('r/{k}.gd', 3, 'GDL004', 'constant-name-case'),
        ('r/{k}.gd', 31, 'GDL210', 'dead-code'),
        ('s/{k}.gd', 10, 'GDL301', 'member-ordering'),
        ('s/{k}.gd', 11, 'GDL301', 'member-ordering'),
        ('s/{k}.gd', 17, 'GDL238', 'no-debug-print'),
        ('s/{k}.gd', 32, 'GDL238', 'no-debug-print'),
        ('s/{k}.gd', 35, 'GDL238', 'no-debug-print'),
        ('s/{k}.gd', 38, 'GDL202', 'unused-parameter'),
        ('s/{k}.gd', 38, 'GDL203', 'empty-function'),
        ('s/{k}.gd', 38, 'GDL252', 'unused-function'),
        ('s/{k}.gd', 5, 'GDL207', 'unused-signal')
        """,
        scenes=False,
    ),
    "code_todo_tags": _rows(
        "path VARCHAR, line INT, tag VARCHAR, note VARCHAR",
        """
        ('s/{k}.gd', 34, 'TODO', 'price of {k}')
        """,
        scenes=False,
    ),
    "code_scene_nodes": _rows(
        "path VARCHAR, node_path VARCHAR, parent VARCHAR, name VARCHAR, type VARCHAR, script VARCHAR, instance VARCHAR, is_unique BOOLEAN, groups VARCHAR, line INT",
        """
        ('GD4011/{k}.tscn', '.', NULL, 'Main', 'Node', 'res://GD4011/{k}.gd', NULL, false, '', 6),
        ('GD4011/{k}.tscn', 'Here', '.', 'Here', 'Timer', NULL, NULL, false, 'all,g{k}', 11),
        ('GD4011/{k}.tscn', 'Here/Below', 'Here', 'Below', 'Node', NULL, 'res://GD4011/gone_{k}.tscn', false, '', 13),
        ('GD4011/{k}.tscn', 'Unique', '.', 'Unique', 'Node', NULL, NULL, true, '', 15)
        """,
        scenes=True,
    ),
    "code_scene_connections": _rows(
        "path VARCHAR, signal VARCHAR, from_node VARCHAR, to_node VARCHAR, method VARCHAR, line INT",
        """
        ('GD4011/{k}.tscn', 'timeout', 'Here', '.', 'gone_method', 19),
        ('GD4011/{k}.tscn', 'timeout', 'Here', '.', 'look', 18)
        """,
        scenes=True,
    ),
    "code_autoloads": _rows(
        "name VARCHAR, target VARCHAR, singleton BOOLEAN, kind VARCHAR",
        """
        ('Fade', 'res://GD4011/{k}.tscn', false, 'scene'),
        ('Global', 'res://s/{k}.gd', true, 'script')
        """,
        scenes=False,
    ),
    "code_resource_properties": _rows(
        "path VARCHAR, script_class VARCHAR, key VARCHAR, value VARCHAR",
        """
        ('t/{k}.tres', 'S{k}', 'balance', '3.5'),
        ('t/{k}.tres', 'S{k}', 'script', 'ExtResource("1")')
        """,
        scenes=False,
    ),
    "code_declared_types": _rows(
        "path VARCHAR, node_id INT, method_id INT, name VARCHAR, type VARCHAR, origin VARCHAR",
        """
        ('r/{k}.gd', 13, 12, 'file', 'Variant', 'unknown'),
        ('r/{k}.gd', 16, 15, 'size', 'int', 'annotation'),
        ('r/{k}.gd', 2, NULL, 'Other', 'Variant', 'unknown'),
        ('r/{k}.gd', 24, 23, 'nothing', 'int', 'literal'),
        ('r/{k}.gd', 25, 23, 'near', 'null', 'literal'),
        ('r/{k}.gd', 3, NULL, 'target', 'Node2D', 'annotation'),
        ('s/{k}.gd', 10, NULL, 'balance', 'float', 'annotation'),
        ('s/{k}.gd', 11, NULL, '_later', 'null', 'literal'),
        ('s/{k}.gd', 12, NULL, '_count', 'int', 'literal'),
        ('s/{k}.gd', 13, NULL, '_unread', 'int', 'literal'),
        ('s/{k}.gd', 9, NULL, 'LIMIT', 'int', 'literal')
        """,
        scenes=False,
    ),
    "code_return_types": _rows(
        "path VARCHAR, method VARCHAR, declared VARCHAR, types VARCHAR",
        """
        ('r/{k}.gd', '_ready', NULL, 'null'),
        ('r/{k}.gd', 'greet', NULL, 'null'),
        ('r/{k}.gd', 'measure', NULL, 'int'),
        ('r/{k}.gd', 'on_ready', NULL, 'Variant'),
        ('r/{k}.gd', 'spare', NULL, 'null'),
        ('s/{k}.gd', '_ready', 'void', 'null'),
        ('s/{k}.gd', '_unused', 'void', 'null'),
        ('s/{k}.gd', '_used', 'void', 'null'),
        ('s/{k}.gd', 'base_{k}', 'int', 'Variant'),
        ('s/{k}.gd', 'make', 'int', 'Variant')
        """,
        scenes=False,
    ),
    "code_parameter_types": _rows(
        "path VARCHAR, method VARCHAR, parameter VARCHAR, types VARCHAR, agreed VARCHAR",
        """
        ('r/{k}.gd', 'greet', 'who', 'String', 'String'),
        ('s/{k}.gd', 'make', 'given', 'Variant', NULL)
        """,
        scenes=False,
    ),
    "code_type_conflicts": _rows(
        "path VARCHAR, line INT, name VARCHAR, want VARCHAR, got VARCHAR",
        """
        ('r/{k}.gd', 23, 'size', 'int', 'String')
        """,
        scenes=False,
    ),
    "code_narrowings": _rows(
        "path VARCHAR, name VARCHAR, type VARCHAR, from_line INT, to_line INT",
        """
        ('r/{k}.gd', 'target', 'not null', 12, 12),
        ('r/{k}.gd', 'thing', 'Node', 29, 29),
        ('r/{k}.gd', 'thing', 'has:step', 29, 29)
        """,
        scenes=False,
    ),
    "code_may_be_null": _rows(
        "path VARCHAR, name VARCHAR, line INT",
        """
        ('r/{k}.gd', 'near', 37)
        """,
        scenes=False,
    ),
    "code_duck_types": _rows(
        "path VARCHAR, name VARCHAR, needs VARCHAR, fits VARCHAR",
        """
        ('r/{k}.gd', 'thing', 'has_method,step', NULL)
        """,
        scenes=False,
    ),
    "code_rename_plan": _rows(
        "path VARCHAR, line INT, col INT, old VARCHAR, new VARCHAR, confidence VARCHAR",
        """
        ('s/{k}.gd', 10, 4, '_count', 'amount', 'Strict'),
        ('s/{k}.gd', 15, 1, '_count', 'amount', 'Strict'),
        ('s/{k}.gd', 17, 7, '_count', 'amount', 'Strict'),
        ('s/{k}.gd', 18, 7, '_count', 'amount', 'Strict'),
        ('s/{k}.gd', 22, 8, '_count', 'amount', 'Strict')
        """,
        scenes=False,
    ),
    "code_quick_fixes": _rows(
        "path VARCHAR, line INT, rule VARCHAR, name VARCHAR, fix VARCHAR",
        """
        ('r/{k}.gd', 3, 'GDL004', 'constant-name-case', 'RenameSymbol'),
        ('r/{k}.gd', 35, 'GDL201', 'unused-variable', 'RemoveText'),
        ('s/{k}.gd', 38, 'GDL202', 'unused-parameter', 'RenameSymbol')
        """,
        scenes=False,
    ),
    "code_unsafe_calls": _rows(
        "path VARCHAR, line INT, code VARCHAR, severity VARCHAR",
        """
        ('r/{k}.gd', 18, 'SEC020', 'High'),
        ('r/{k}.gd', 9, 'SEC010', 'Critical')
        """,
        scenes=False,
    ),
    "code_signal_connections": _rows(
        "path VARCHAR, signal VARCHAR, callback VARCHAR, line INT",
        """
        ('r/{k}.gd', 'ready', 'on_ready', 8)
        """,
        scenes=False,
    ),
    "code_scene_edges": _rows(
        "src VARCHAR, dst VARCHAR, kind VARCHAR",
        """
        ('GD4011/{k}.tscn', 'GD4011/{k}.gd', 'Script'),
        ('GD4011/{k}.tscn', 'GD4011/gone_{k}.tscn', 'SubScene')
        """,
        scenes=True,
    ),
}
