"""The same results in plain SQL, from the star-schema tables alone."""

from __future__ import annotations

from codeloom.plans import prompts as P
from codeloom.plans.star import STAR_CTES

# Stand-in for a line break inside the SQL below.
_NL = "chr(10)"


def _q(text: str) -> str:
    """SQL text literal; line breaks as chr(10)."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def _json(value: str) -> str:
    return f"CAST(to_json({value}) AS varchar)"


_TEXTS = f"""
mtext AS (
  SELECT struct_name,
    string_agg('      - ' || name || CASE WHEN i = 1 THEN '(int)' ELSE '()' END || ' (string)' || {_NL}
      || CASE WHEN file_path = struct_file THEN '        Comment: ' || comment_txt || {_NL} ELSE '' END, '' ORDER BY file_path, pos) AS body,
    string_agg(name || CASE WHEN i = 1 THEN '(int)' ELSE '()' END || 'string'
      || CASE WHEN file_path = struct_file THEN comment_txt ELSE '' END || ';', '' ORDER BY file_path, pos) AS flat,
    string_agg('        - ' || name || CASE WHEN i = 1 THEN '(int)' ELSE '()' END || ' (string) (Comment: "'
      || CASE WHEN file_path = struct_file THEN comment_txt ELSE '' END || '")' || {_NL}, '' ORDER BY file_path, pos) AS report,
    string_agg('{{"Name":' || {_json('name')} || ',"Comment":' || CASE WHEN file_path = struct_file THEN {_json('comment_txt')} ELSE '""' END
      || ',"Parameters":' || CASE WHEN i = 1 THEN '["int"]' ELSE '[]' END || ',"ReturnTypes":["string"]}}', ',' ORDER BY file_path, pos) AS js
  FROM meths GROUP BY struct_name),
shown AS (
  SELECT d.*, CASE kind_id
      WHEN 0 THEN '  Struct: ' || fq_name || {_NL} || '    Comment: ' || comment_txt || {_NL} || '    Fields:' || {_NL}
        || '      - Brand string' || {_NL} || '      - Size int' || {_NL} || '    Methods:' || {_NL} || m.body
      WHEN 1 THEN '  Interface: ' || fq_name || {_NL} || '    Comment: ' || comment_txt || {_NL} || '    Methods:' || {_NL} || '      - Do(int) (error)' || {_NL}
      WHEN 2 THEN '  Function: ' || fq_name || {_NL} || '    Comment: ' || comment_txt || {_NL} || '    Signature: (a int, b int, s string) -> (int, error)' || {_NL}
      WHEN 3 THEN '  Const: ' || fq_name || ' untyped int = ' || size_txt || {_NL} || '    Comment: ' || comment_txt || {_NL}
      ELSE '  Var: ' || fq_name || ' string = "' || p_brand || '"' || {_NL} || '    Comment: ' || comment_txt || {_NL} END AS text
  FROM decls d LEFT JOIN mtext m ON m.struct_name = d.fq_name),
items AS (
  SELECT u.project, u.file_path, u.kind, u.fq_name, min(u.pos) AS pos, min(u.ext_type) AS ext_type,
         min(u.ext_value) AS ext_value, bool_or(u.ext_is_const) AS ext_is_const
  FROM uses u GROUP BY u.project, u.file_path, u.kind, u.fq_name),
placed AS (
  SELECT i.project, i.file_path, i.fq_name,
    CASE i.kind WHEN 'type' THEN 5 WHEN 'call' THEN 6 ELSE 7 END AS section,
    CASE i.kind WHEN 'call' THEN i.pos ELSE 0 END AS ord,
    CASE i.kind WHEN 'type' THEN coalesce(s.text, '- ' || i.fq_name || {_NL}) WHEN 'call' THEN s.text
      ELSE coalesce(s.text, CASE WHEN i.ext_is_const THEN '  Const: ' || i.fq_name || ' ' || i.ext_type || ' = ' || i.ext_value
        ELSE '  Var: ' || i.fq_name || ' ' || i.ext_type END || {_NL}) END AS text,
    s.text IS NOT NULL AS resolved
  FROM items i LEFT JOIN shown s ON s.project = i.project AND s.fq_name = i.fq_name),
files AS (
  SELECT project, pkg_path, pkg_name, file_path, coalesce(string_agg(target_pkg, ',' ORDER BY target_pkg), '') AS imports,
    coalesce(string_agg('- ' || target_pkg || {_NL}, '' ORDER BY target_pkg), '') AS listed,
    coalesce(string_agg({_json('target_pkg')}, ',' ORDER BY target_pkg), '') AS js,
    coalesce(string_agg('    - ' || target_pkg || {_NL}, '' ORDER BY target_pkg), '') AS report
  FROM (SELECT DISTINCT project, pkg_path, pkg_name, file_path, target_pkg FROM uses
        UNION SELECT project, pkg_path, pkg_name, file_path, NULL FROM decls
        UNION SELECT project, pkg_path, pkg_name, file_path, NULL FROM meths) GROUP BY project, pkg_path, pkg_name, file_path),
headers AS (
  SELECT *, '--- File: ' || file_path || ' ---' || {_NL} || 'Package: ' || pkg_name || {_NL} || {_NL}
    || CASE WHEN imports = '' THEN '' ELSE 'Imports:' || {_NL} || listed || {_NL} END AS header FROM files),
local_text AS (
  SELECT project, file_path,
    string_agg(CASE WHEN kind_id = 2 THEN replace(text, fq_name, name) END, '' ORDER BY pos) AS fns,
    string_agg(CASE WHEN kind_id > 2 THEN replace(text, fq_name, name) END, '' ORDER BY pos) AS gvs,
    string_agg(CASE WHEN kind_id = 0 THEN text END, '' ORDER BY fq_name) AS sts,
    string_agg(CASE WHEN kind_id = 1 THEN text END, '' ORDER BY fq_name) AS its
  FROM shown GROUP BY project, file_path),
used_text AS (
  SELECT project, file_path, count(*) AS n_items, count(*) FILTER (WHERE NOT resolved AND section = 5) AS n_unresolved,
    'Used Items From Other Packages:' || {_NL} || string_agg(text, '' ORDER BY section, ord, fq_name) AS text
  FROM placed WHERE text IS NOT NULL GROUP BY project, file_path),
contexts AS (
  SELECT h.project, h.file_path, h.header
    || coalesce('Functions:' || {_NL} || l.fns || {_NL}, '') || coalesce('Global Variables/Constants:' || {_NL} || l.gvs || {_NL}, '')
    || coalesce('Local Structs:' || {_NL} || l.sts, '') || coalesce('Local Interfaces:' || {_NL} || l.its, '') || coalesce(u.text, '') AS text
  FROM headers h LEFT JOIN local_text l ON l.project = h.project AND l.file_path = h.file_path
  LEFT JOIN used_text u ON u.project = h.project AND u.file_path = h.file_path),
asked AS (SELECT request_id, project_path, file_path, project_path || '/' || file_path AS full_path FROM requests),
calls AS (
  SELECT u.project, u.file_path, u.pos, u.fq_name, d.comment_txt
  FROM uses u JOIN decls d ON d.project = u.project AND d.fq_name = u.fq_name WHERE u.kind = 'call'),
values_used AS (
  SELECT i.project, i.file_path, i.fq_name, coalesce(d.comment_txt, '') AS comment, i.ext_type AS type,
    CASE WHEN d.fq_name IS NULL THEN coalesce(i.ext_value, '') WHEN d.kind_id = 3 THEN d.size_txt ELSE '"' || d.p_brand || '"' END AS value, i.ext_is_const AS is_const
  FROM items i LEFT JOIN decls d ON d.project = i.project AND d.fq_name = i.fq_name WHERE i.kind = 'value'),
local_json AS (
  SELECT d.project, d.file_path,
    string_agg(CASE WHEN kind_id = 2 THEN '{{"Name":' || {_json('name')} || ',"Comment":' || {_json('comment_txt')}
      || ',"Params":["a int","b int","s string"],"Returns":["int","error"]}}' END, ',' ORDER BY pos) AS fns,
    string_agg(CASE WHEN kind_id = 0 THEN '{{"Name":' || {_json('fq_name')} || ',"Comment":' || {_json('comment_txt')}
      || ',"Fields":[{{"Name":"Brand","Type":"string"}},{{"Name":"Size","Type":"int"}}],"Methods":[' || m.js || ']}}' END, ',' ORDER BY fq_name) AS sts,
    string_agg(CASE WHEN kind_id = 1 THEN '{{"Name":' || {_json('fq_name')} || ',"Comment":' || {_json('comment_txt')}
      || ',"Methods":[{{"Name":"Do","Comment":"","Parameters":["int"],"ReturnTypes":["error"]}}],"Embeddeds":[]}}' END, ',' ORDER BY fq_name) AS its,
    string_agg(CASE WHEN kind_id > 2 THEN '{{"Name":' || {_json('name')} || ',"Comment":' || {_json('comment_txt')}
      || CASE WHEN kind_id = 3 THEN ',"Type":"untyped int","Value":' || {_json('size_txt')} || ',"IsConst":true}}'
         ELSE ',"Type":"string","Value":' || {_json("'\"' || p_brand || '\"'")} || ',"IsConst":false}}' END END, ',' ORDER BY pos) AS gvs
  FROM decls d LEFT JOIN mtext m ON m.struct_name = d.fq_name GROUP BY d.project, d.file_path),
type_json AS (
  SELECT project, file_path, string_agg('{{"Name":' || {_json('fq_name')} || ',"Comment":"","Fields":null,"Methods":null}}', ',' ORDER BY fq_name) AS js
  FROM items WHERE kind = 'type' GROUP BY project, file_path),
call_json AS (
  SELECT project, file_path, string_agg('{{"Name":' || {_json('fq_name')} || ',"Comment":' || {_json('comment_txt')}
    || ',"Params":["a int","b int","s string"],"Returns":["int","error"]}}', ',' ORDER BY pos, fq_name) AS js
  FROM calls GROUP BY project, file_path),
value_json AS (
  SELECT project, file_path, string_agg('{{"Name":' || {_json('fq_name')} || ',"Comment":' || {_json('comment')} || ',"Type":' || {_json('type')}
    || ',"Value":' || {_json('value')} || ',"IsConst":' || CASE WHEN is_const THEN 'true' ELSE 'false' END || '}}', ',' ORDER BY fq_name) AS js
  FROM values_used GROUP BY project, file_path),
json_rows AS (
  SELECT f.project, f.file_path, '{{"PackageName":' || {_json('f.pkg_name')} || ',"Imports":[' || f.js || '],"Functions":[' || coalesce(l.fns, '')
    || '],"Structs":[' || coalesce(l.sts, '') || '],"Interfaces":[' || coalesce(l.its, '') || '],"GlobalVars":[' || coalesce(l.gvs, '')
    || '],"UsedImportedStructs":[' || coalesce(t.js, '') || '],"UsedImportedFunctions":' || coalesce('[' || c.js || ']', 'null')
    || ',"UsedImportedGlobalVars":[' || coalesce(v.js, '') || ']}}' AS json
  FROM files f LEFT JOIN local_json l ON l.project = f.project AND l.file_path = f.file_path
  LEFT JOIN type_json t ON t.project = f.project AND t.file_path = f.file_path
  LEFT JOIN call_json c ON c.project = f.project AND c.file_path = f.file_path
  LEFT JOIN value_json v ON v.project = f.project AND v.file_path = f.file_path),
json_pieces AS (
  SELECT *, CASE WHEN file_path = min(file_path) OVER (PARTITION BY project) THEN '' ELSE ',' END AS comma FROM json_rows),
context_pieces AS (
  SELECT DISTINCT project, '0' AS part, '[' AS text FROM json_rows UNION ALL SELECT DISTINCT project, '2', ']' FROM json_rows
  UNION ALL SELECT project, '1/' || file_path, comma || '{{"fileInfo":' || json || ',"filePath":' || {_json('file_path')} || '}}' FROM json_pieces)
"""

_LOCAL_NAMES = """
  SELECT project, file_path, string_agg(CASE WHEN kind_id = 2 THEN name END, ',' ORDER BY pos) AS fns,
    string_agg(CASE WHEN kind_id = 0 THEN fq_name END, ',' ORDER BY fq_name) AS sts,
    string_agg(CASE WHEN kind_id = 1 THEN fq_name END, ',' ORDER BY fq_name) AS its,
    string_agg(CASE WHEN kind_id > 2 THEN name END, ',' ORDER BY pos) AS gvs FROM decls GROUP BY project, file_path"""


def _names_of(kind: str, order: str) -> str:
    source = "calls" if kind == "call" else f"(SELECT * FROM items WHERE kind = '{kind}')"
    return f"SELECT project, file_path, string_agg(fq_name, ',' ORDER BY {order}) AS names FROM {source} GROUP BY project, file_path"


_SELECTS: dict[str, str] = {
    "symbol_map": """SELECT project, CASE WHEN kind_id = 2 THEN name ELSE fq_name END AS fq_name, CASE kind_id WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank,
        CASE WHEN kind_id = 2 THEN replace(text, fq_name, name) ELSE text END AS text FROM shown WHERE kind_id < 3""",
    "foreign_refs": "SELECT project, file_path, pos, target_pkg, target_name FROM all_uses WHERE target_pkg <> pkg_path",
    "used_types": "SELECT project, file_path, fq_name FROM items WHERE kind = 'type'",
    "used_functions": "SELECT project, file_path, pos, fq_name, comment_txt AS comment, 'a int,b int,s string' AS params, 'int,error' AS returns FROM calls",
    "used_globals": "SELECT project, file_path, fq_name, comment, type, value, is_const FROM values_used",
    "resolve_used_types": "SELECT project, file_path, fq_name, resolved, text FROM placed WHERE section = 5",
    "dedupe_used_items": "SELECT project, file_path, fq_name, section, ord, text FROM placed WHERE text IS NOT NULL",
    "used_items_text": "SELECT project, file_path, n_items, n_unresolved, text FROM used_text",
    "dedupe_types": """SELECT project, file_path, name, pos, comment FROM (
        SELECT project, file_path, pkg_path || '.' || p_brand AS name, pos, comment_txt AS comment,
          row_number() OVER (PARTITION BY project, file_path, pkg_path || '.' || p_brand ORDER BY pos DESC) AS rn FROM decls WHERE kind_id < 2) WHERE rn = 1""",
    "struct_methods": "SELECT d.project, d.file_path, d.fq_name AS name, m.flat AS methods FROM decls d JOIN mtext m ON m.struct_name = d.fq_name",
    "format_function": "SELECT project, fq_name, text FROM shown WHERE kind_id = 2",
    "format_global": "SELECT project, fq_name, text FROM shown WHERE kind_id > 2",
    "format_struct": "SELECT project, fq_name, text FROM shown WHERE kind_id = 0",
    "format_interface": "SELECT project, fq_name, text FROM shown WHERE kind_id = 1",
    "compose_context": "SELECT project, file_path, text FROM contexts",
    "lookup_file": """SELECT a.request_id, a.full_path AS file_path, h.header IS NOT NULL AS found, coalesce(h.header, '') AS text,
        CASE WHEN h.header IS NULL THEN 'file info not found for path: ' || a.full_path ELSE '' END AS error
        FROM asked a LEFT JOIN headers h ON h.file_path = a.full_path WHERE a.full_path IS NOT NULL""",
    "serve_requests": """SELECT a.request_id, c.text IS NULL AS is_error,
        CASE WHEN a.project_path IS NULL THEN 'required argument "projectPath" not found'
             WHEN a.file_path IS NULL THEN 'required argument "filePath" not found'
             WHEN c.text IS NOT NULL THEN c.text
             WHEN EXISTS (SELECT 1 FROM files f WHERE starts_with(f.file_path, a.project_path || '/'))
               THEN 'failed to compose project info: file info not found for path: ' || a.full_path
             ELSE 'failed to parse project: no packages found in ' || a.project_path END AS text
        FROM asked a LEFT JOIN contexts c ON c.file_path = a.full_path""",
    "file_info": f"""SELECT f.project, f.file_path, f.pkg_name AS package_name, f.imports, coalesce(l.fns, '') AS functions, coalesce(l.sts, '') AS structs,
        coalesce(l.its, '') AS interfaces, coalesce(l.gvs, '') AS globals, coalesce(t.names, '') AS used_types, coalesce(c.names, '') AS used_functions, coalesce(v.names, '') AS used_globals
        FROM files f LEFT JOIN ({_LOCAL_NAMES}) l ON l.project = f.project AND l.file_path = f.file_path
        LEFT JOIN ({_names_of('type', 'fq_name')}) t ON t.project = f.project AND t.file_path = f.file_path
        LEFT JOIN ({_names_of('call', 'pos, fq_name')}) c ON c.project = f.project AND c.file_path = f.file_path
        LEFT JOIN ({_names_of('value', 'fq_name')}) v ON v.project = f.project AND v.file_path = f.file_path""",
    "export_json": "SELECT project, file_path, json FROM json_rows",
    "project_json": f"""SELECT DISTINCT project, '0' AS part, '{{' AS text FROM json_rows UNION ALL SELECT DISTINCT project, '2', '}}' FROM json_rows
        UNION ALL SELECT project, '1/' || file_path, comma || {_json('file_path')} || ':' || json FROM json_pieces""",
    "project_context_json": "SELECT project, part, text FROM context_pieces",
    "project_report": f"""SELECT f.project, f.file_path, chr(10) || '--- File: ' || f.file_path || ' ---' || chr(10) || '  Package Name: ' || f.pkg_name || chr(10)
        || '  Imports:' || chr(10) || CASE WHEN f.report = '' THEN '    (None)' || chr(10) ELSE f.report END
        || '  Functions:' || chr(10) || coalesce(l.fns, '    (None)' || chr(10))
        || '  Local Structs:' || chr(10) || coalesce(l.sts, '    (None)' || chr(10))
        || '  Used Imported Structs:' || chr(10) || coalesce(t.names, '    (None)' || chr(10)) AS text
        FROM files f LEFT JOIN (
          SELECT d.project, d.file_path, string_agg(CASE WHEN kind_id = 2 THEN '    - ' || name || chr(10) END, '' ORDER BY pos) AS fns,
            string_agg(CASE WHEN kind_id = 0 THEN '    - ' || fq_name || ' (Comment: "' || comment_txt || '")' || chr(10) || '      Fields:' || chr(10)
              || '        - Brand string' || chr(10) || '        - Size int' || chr(10) || '      Methods:' || chr(10) || m.report END, '' ORDER BY fq_name) AS sts
          FROM decls d LEFT JOIN mtext m ON m.struct_name = d.fq_name GROUP BY d.project, d.file_path) l ON l.project = f.project AND l.file_path = f.file_path
        LEFT JOIN (SELECT project, file_path, string_agg('    - ' || fq_name || chr(10), '' ORDER BY fq_name) AS names FROM items WHERE kind = 'type' GROUP BY project, file_path) t
          ON t.project = f.project AND t.file_path = f.file_path""",
    "package_nodes": """SELECT n.project, n.pkg_path, coalesce(fn.names, '') AS functions, coalesce(dep.names, '') AS depends_on, n.names AS files
        FROM (SELECT project, pkg_path, string_agg(file_path, ',' ORDER BY file_path) AS names FROM files GROUP BY project, pkg_path) n
        LEFT JOIN (SELECT project, pkg_path, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM decls WHERE kind_id = 2 GROUP BY project, pkg_path) fn
          ON fn.project = n.project AND fn.pkg_path = n.pkg_path
        LEFT JOIN (SELECT project, pkg_path, string_agg(DISTINCT target_pkg, ',' ORDER BY target_pkg) AS names FROM uses GROUP BY project, pkg_path) dep
          ON dep.project = n.project AND dep.pkg_path = n.pkg_path""",
    "package_edges": """SELECT DISTINCT project, pkg_path, 'Files' AS list, file_path AS item FROM files UNION ALL SELECT DISTINCT project, pkg_path, 'DependsOn', target_pkg FROM uses
        UNION ALL SELECT DISTINCT project, pkg_path, 'Functions', name FROM decls WHERE kind_id = 2""",
    "prompt_messages": f"""SELECT project, 0 AS ordinal, '' AS part, 'system' AS role, {_q(P.SYSTEM_TEXT)} AS content FROM (SELECT DISTINCT project FROM json_rows)
        UNION ALL SELECT project, 1, part, 'user', CASE part WHEN '0' THEN {_q(P.PROJECT_HEAD)} ELSE '' END || text || CASE part WHEN '2' THEN {_q(P.PROJECT_TAIL)} ELSE '' END FROM context_pieces
        UNION ALL SELECT project, 2, '', 'user', {_q(P.FOCUS_TEXT.format('P7'))} FROM (SELECT DISTINCT project FROM json_rows)
        UNION ALL SELECT project, 3, '', 'user', {_q(P.MINIFY_TEXT)} FROM (SELECT DISTINCT project FROM json_rows)""",
    "has_content": "SELECT project, bool_or(pkg_name <> '') AS has_content FROM files GROUP BY project",
    "validate_args": """SELECT request_id, coalesce(project, '') AS project, CASE WHEN coalesce(project, '') = '' THEN 'projectPath is required'
        WHEN project IN (SELECT project FROM files) THEN '' ELSE 'failed to parse project: no packages found in ' || project END AS error
        FROM (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN '' ELSE 'r' || CAST(s_suppkey % 7 AS varchar) END AS project FROM supplier)""",
    "changed_files": "SELECT DISTINCT project, file_path FROM uses WHERE c_custkey % 10 = 0 OR c_custkey % 11 = 0",
    "refresh_stale": """SELECT project, file_path, CASE min(rank) WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' ELSE 'quotes' END AS reason FROM (
        SELECT project, file_path, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END AS rank FROM uses WHERE (c_custkey % 13 = 0) <> (c_custkey % 11 = 0)
        UNION ALL SELECT project, file_path, 1 FROM decls WHERE kind_id = 3 AND k % 10 = 0
        UNION ALL SELECT u.project, u.file_path, 2 FROM uses u JOIN decls d ON d.fq_name = u.fq_name AND d.project = u.project
          WHERE d.kind_id = 3 AND d.k % 10 = 0 AND u.c_custkey % 13 <> 0)
        WHERE project IN ('r0', 'r1', 'r2') GROUP BY project, file_path""",
    "extract_package_imports": "SELECT project, pkg_path, file_path, pkg_name AS package_name, imports FROM files",
    "extract_functions": """SELECT project, file_path, name, fq_name, comment_txt AS comment, 'a int,b int,s string' AS params, 'int,error' AS returns FROM decls WHERE kind_id = 2
        UNION ALL SELECT DISTINCT project, file_path, 'C' || CAST(c_custkey AS varchar), pkg_path || '.C' || CAST(c_custkey AS varchar), '', '', '' FROM uses""",
    "extract_params": """SELECT project, file_path, name, n, param FROM decls
        JOIN (VALUES (0, 'a int'), (1, 'b int'), (2, 's string')) v(n, param) ON true WHERE kind_id = 2""",
    "extract_returns": "SELECT project, file_path, name, n, type FROM decls JOIN (VALUES (0, 'int'), (1, 'error')) v(n, type) ON true WHERE kind_id = 2",
    "extract_structs": "SELECT project, file_path, fq_name AS name, comment_txt AS comment, 'Brand string;Size int;' AS fields FROM decls WHERE kind_id = 0",
    "extract_methods": "SELECT d.project, d.file_path, d.fq_name AS name, m.flat AS methods FROM decls d JOIN mtext m ON m.struct_name = d.fq_name",
    "extract_interfaces": "SELECT project, file_path, fq_name AS name, comment_txt AS comment, 'Do(int)error;' AS methods, '' AS embeddeds FROM decls WHERE kind_id = 1",
    "extract_globals": """SELECT project, file_path, name, comment_txt AS comment, CASE WHEN kind_id = 3 THEN 'untyped int' ELSE 'string' END AS type,
        CASE WHEN kind_id = 3 THEN size_txt ELSE '"' || p_brand || '"' END AS value, kind_id = 3 AS is_const FROM decls WHERE kind_id > 2
        UNION ALL SELECT project, file_path, '_', '', fq_name, '', false FROM uses WHERE kind = 'type'""",
    "qualify_type": "SELECT project, file_path, fq_name AS type, count(*) AS n FROM uses WHERE kind = 'type' GROUP BY project, file_path, fq_name",
    "extract_refs": "SELECT project, file_path, kind, target_pkg, target_name, count(*) AS n FROM uses GROUP BY project, file_path, kind, target_pkg, target_name",
    # From text alone the type and value of a name outside the project are unknown, and a
    # function-local 'var _ T' is a global of its file.
    "extract_context": """SELECT h.project, h.file_path, h.header
        || coalesce('Functions:' || chr(10) || coalesce(l.fns, c.fn) || chr(10), '') || coalesce('Global Variables/Constants:' || chr(10) || coalesce(l.gvs, g.gvs) || chr(10), '')
        || coalesce('Local Structs:' || chr(10) || l.sts, '') || coalesce('Local Interfaces:' || chr(10) || l.its, '') || coalesce(u.text, '') AS text
        FROM headers h LEFT JOIN local_text l ON l.project = h.project AND l.file_path = h.file_path
        LEFT JOIN (SELECT DISTINCT project, file_path, '  Function: C' || CAST(c_custkey AS varchar) || chr(10) || '    Signature: ()' || chr(10) AS fn FROM uses) c
          ON c.project = h.project AND c.file_path = h.file_path
        LEFT JOIN (SELECT project, file_path, string_agg('  Var: _ ' || fq_name || chr(10), '' ORDER BY pos, alias || '.' || target_name) AS gvs FROM uses WHERE kind = 'type' GROUP BY project, file_path) g
          ON g.project = h.project AND g.file_path = h.file_path
        LEFT JOIN (SELECT p.project, p.file_path, 'Used Items From Other Packages:' || chr(10) || string_agg(
            CASE WHEN p.section = 7 AND NOT p.resolved THEN '  Var: ' || p.fq_name || ' ' || chr(10) ELSE p.text END, '' ORDER BY p.section, r.ord, p.fq_name) AS text
          FROM placed p JOIN (
            SELECT project, file_path, fq_name, CASE kind WHEN 'call' THEN min(n) ELSE 0 END AS ord FROM (
              SELECT project, file_path, kind, fq_name, row_number() OVER (PARTITION BY project, file_path ORDER BY pos,
                CASE kind WHEN 'type' THEN 'var _ ' || alias WHEN 'call' THEN alias ELSE '_ = ' || alias END || '.' || target_name) AS n FROM uses)
            GROUP BY project, file_path, kind, fq_name) r ON r.project = p.project AND r.file_path = p.file_path AND r.fq_name = p.fq_name
          WHERE p.text IS NOT NULL GROUP BY p.project, p.file_path) u ON u.project = h.project AND u.file_path = h.file_path""",
    "package_path": "SELECT project, file_path, pkg_path FROM files",
    "module_path": """SELECT f.file_path, '/corpus/' || f.project || CASE WHEN p.nk % 5 = 0 THEN '/' || f.pkg_name ELSE '' END AS project,
        CASE WHEN p.nk % 5 = 0 THEN 'nested.com/' || f.pkg_name ELSE f.pkg_path END AS pkg_path FROM files f JOIN pkgs p ON p.pkg_path = f.pkg_path""",
    "nonempty": """SELECT a.project, coalesce(f.n_packages, 0) AS n_packages, coalesce(f.n_files, 0) AS n_files,
        CASE WHEN f.project IS NULL THEN 'no packages found in ' || a.project ELSE 'ok' END AS status
        FROM (SELECT DISTINCT 'r' || CAST(s_suppkey % 7 AS varchar) AS project FROM supplier) a
        LEFT JOIN (SELECT project, count(DISTINCT pkg_path) AS n_packages, count(*) AS n_files FROM files GROUP BY project) f ON f.project = a.project""",
    "quarantine": """SELECT f.project, f.file_path, CASE WHEN c % 7 = 0 THEN 'missing package clause' WHEN c % 8 = 0 THEN 'unbalanced braces'
        WHEN c % 9 = 0 THEN 'empty file' ELSE '' END AS error
        FROM files f LEFT JOIN (SELECT DISTINCT file_path AS path, c_custkey AS c FROM uses) u ON u.path = f.file_path""",
}

ORACLES: dict[str, str] = {name: f"WITH {STAR_CTES}, {_TEXTS} {select}" for name, select in _SELECTS.items()}
