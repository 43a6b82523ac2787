"""Grammars of PL/SQL, VBA and Python 3 for the derivative parser, over the token kinds of `lexers`.

They describe form alone: names, types and scopes stay unresolved. Rules over expressions are flat (operand operator
operand ...), since precedence decides no file's validity.
"""

from __future__ import annotations

PLSQL = r"""
file: 'SLASH'* (unit 'SLASH'+ | command ';' 'SLASH'*)* unit? ;
unit: 'CREATE' ('OR' 'REPLACE')? ('EDITIONABLE' | 'NONEDITIONABLE')?
      (package_spec | package_body | procedure | function | trigger | type_object) | block ;
command: sql | 'COMMIT' ID? | 'ROLLBACK' to_savepoint? | 'SAVEPOINT' id | ddl ;
ddl: 'CREATE' ('OR' 'REPLACE')? ('TABLE' | 'INDEX' | 'VIEW' | 'UNIQUE' | ID) soup+ | ('GRANT' | 'DROP' | 'ALTER' | 'COMMENT' | 'TRUNCATE') soup+ ;
soup: id | 'NUMBER' | 'STRING' | NUMBER | STRING | ',' | '.' | '=' | '*' | '/' | '+' | '-' | '<' | '>' | '<=' | '>=' | '<>' | '||' | '%'
    | 'TABLE' | 'INDEX' | 'VIEW' | 'ON' | 'TO' | 'AS' | 'IS' | 'NOT' | 'NULL' | 'DEFAULT' | 'UNIQUE' | 'SELECT' | 'FROM' | 'WHERE' | 'AND'
    | 'OR' | 'IN' | 'UPDATE' | 'DELETE' | 'INSERT' | 'EXECUTE' | 'ALL' | 'WITH' | 'USING' | 'SET' | 'FOR' | 'BY' | 'START' | 'GROUP'
    | 'ORDER' | 'HAVING' | 'UNION' | 'DISTINCT' | 'JOIN' | 'LEFT' | 'RIGHT' | 'INNER' | 'OUTER' | 'FULL' | 'DROP' | 'LIKE' | 'BETWEEN'
    | 'CASE' | 'WHEN' | 'THEN' | 'ELSE' | 'END' | 'DESC' | 'PACKAGE' | 'BODY' | 'PROCEDURE' | 'FUNCTION' | 'TRIGGER'
    | '(' soup* ')' ;

id: ID | 'BODY' | 'BULK' | 'COLLECT' | 'COMMENT' | 'CONSTANT' | 'CONTINUE' | 'CROSS' | 'CURRENT' | 'DETERMINISTIC' | 'EACH' | 'EDITIONABLE'
  | 'ESCAPE' | 'FULL' | 'IMMEDIATE' | 'INNER' | 'INSTEAD' | 'JOIN' | 'LANGUAGE' | 'LEFT' | 'LIMIT' | 'NATURAL' | 'NOCOPY'
  | 'NONEDITIONABLE' | 'NULLS' | 'OUT' | 'OUTER' | 'OVER' | 'PARTITION' | 'PIPE' | 'PIPELINED' | 'PRIOR' | 'RANGE' | 'RECORD' | 'REF'
  | 'REPLACE' | 'RETURNING' | 'REVERSE' | 'RIGHT' | 'ROW' | 'WITHIN' | 'BEFORE' | 'AFTER' | 'VARRAY' | 'RESULT_CACHE' | 'PARALLEL_ENABLE'
  | 'MOD' | 'MULTISET' | 'MEMBER' | 'ACCESSIBLE' | 'AUTHID' | 'TRUNCATE' | 'MERGE' | 'EXECUTE' ;
qname: id ('.' id)* ;

package_spec: 'PACKAGE' qname package_option* ('IS' | 'AS') spec_item* 'END' id? ';' ;
package_option: 'AUTHID' id | 'ACCESSIBLE' 'BY' '(' soup* ')' ;
package_body: 'PACKAGE' 'BODY' qname ('IS' | 'AS') item* ('BEGIN' statements handlers?)? 'END' id? ';' ;
spec_item: declaration | 'PROCEDURE' qname parameters? routine_option* ';' | 'FUNCTION' qname parameters? 'RETURN' datatype routine_option* ';' ;
item: declaration | procedure | function ;
procedure: 'PROCEDURE' qname parameters? routine_option* (';' | ('IS' | 'AS') routine_body) ;
function: 'FUNCTION' qname parameters? 'RETURN' datatype routine_option* (';' | ('IS' | 'AS') routine_body) ;
routine_option: 'DETERMINISTIC' | 'PIPELINED' | 'AUTHID' id | 'RESULT_CACHE' | 'PARALLEL_ENABLE' ('(' soup* ')')? | 'ACCESSIBLE' 'BY' '(' soup* ')' ;
routine_body: item* 'BEGIN' statements handlers? 'END' id? ';' | 'LANGUAGE' soup+ ';' ;
parameters: '(' parameter (',' parameter)* ')' ;
parameter: id 'IN'? 'OUT'? 'NOCOPY'? datatype default? ;
default: (':=' | 'DEFAULT') expr ;
datatype: 'REF'? qname ('@' qname)? ('%' ('TYPE' | id))? ('(' size (',' size)* ')')? ID* ('WITH' ID* )? ('TO' ID ('(' size ')')?)? ;
size: ('-'? NUMBER | id) ID? | '*' ;
trigger: 'TRIGGER' qname ('BEFORE' | 'AFTER' | 'INSTEAD' 'OF') event ('OR' event)* 'ON' qname
         (ID soup+)? ('FOR' 'EACH' 'ROW')? ('WHEN' '(' expr ')')? block ;
event: 'INSERT' | 'DELETE' | 'UPDATE' ('OF' id (',' id)*)? | id ;
type_object: 'TYPE' 'BODY'? qname ('IS' | 'AS') soup+ ';' ;

declaration: id declared ';' | 'CURSOR' id parameters? ('RETURN' datatype)? ('IS' query)? ';'
  | 'TYPE' id 'IS' type_definition ';' | 'SUBTYPE' id 'IS' datatype ('RANGE' expr '..' expr)? ('NOT' 'NULL')? ';' | 'PRAGMA' id ('(' soup* ')')? ';' ;
declared: 'EXCEPTION' | 'CONSTANT'? datatype ('NOT' 'NULL')? default? ;
type_definition: 'RECORD' '(' field (',' field)* ')' | 'TABLE' 'OF' datatype ('NOT' 'NULL')? ('INDEX' 'BY' datatype)?
  | 'VARRAY' '(' NUMBER ')' 'OF' datatype | 'REF' 'CURSOR' ('RETURN' datatype)? | '(' soup* ')' ;
field: id datatype ('NOT' 'NULL')? default? ;

block: ('DECLARE' item*)? 'BEGIN' statements handlers? 'END' id? ';' ;
statements: labelled+ ;
handlers: 'EXCEPTION' ('WHEN' handler_name ('OR' handler_name)* 'THEN' statements)+ ;
handler_name: qname ;
labelled: ('<<' id '>>')* statement ;
statement: block | 'NULL' ';' | assignment_or_call ';' | 'RETURN' expr? ';' | 'RAISE' qname? ';' | 'GOTO' id ';'
  | ('EXIT' | 'CONTINUE') id? ('WHEN' expr)? ';' | if | case | loop | forall | command ';'
  | 'OPEN' target ('(' arguments? ')')? ('FOR' (query | expr) using?)? ';'
  | 'FETCH' target ('BULK' 'COLLECT')? 'INTO' target (',' target)* ('LIMIT' expr)? ';' | 'CLOSE' target ';'
  | 'EXECUTE' 'IMMEDIATE' expr (('BULK' 'COLLECT')? 'INTO' target (',' target)*)? using? (('RETURNING' | 'RETURN') 'INTO' target (',' target)*)? ';'
  | 'PIPE' 'ROW' '(' expr ')' ';' | 'LOCK' 'TABLE' soup+ ';' | 'SET' soup+ ';' | 'PRAGMA' id ('(' soup* ')')? ';' ;
to_savepoint: 'TO' ID? id ;
using: 'USING' bind (',' bind)* ;
bind: 'IN'? 'OUT'? expr ;
assignment_or_call: target (':=' expr)? ;
target: (':' id | id) ('.' ('DELETE' | 'EXISTS' | id) | '(' arguments? ')' | '@' qname | '%' id)* ;
if: 'IF' expr 'THEN' statements ('ELSIF' expr 'THEN' statements)* ('ELSE' statements)? 'END' 'IF' ';' ;
case: 'CASE' expr? ('WHEN' expr 'THEN' statements)+ ('ELSE' statements)? 'END' 'CASE' id? ';' ;
loop: ('WHILE' expr | 'FOR' id 'IN' range)? 'LOOP' statements 'END' 'LOOP' id? ';' ;
range: 'REVERSE'? expr ('..' expr)? | '(' query ')' ;
forall: 'FORALL' id 'IN' (expr '..' expr | id 'OF' expr) (ID ID)? sql ';' ;

sql: query_with_into | insert | update | delete | merge ;
query_with_into: query ;
query: ('WITH' common (',' common)*)? select (('UNION' 'ALL'? | 'INTERSECT' | 'MINUS') select)* order? for_update? ;
common: id ('(' id (',' id)* ')')? 'AS' '(' query ')' ;
select: '(' query ')' | 'SELECT' ('DISTINCT' | 'UNIQUE' | 'ALL')? column (',' column)*
  (('BULK' 'COLLECT')? 'INTO' target (',' target)*)? 'FROM' source (',' source)* where? hierarchy? group? ;
column: '*' | expr ('AS'? id)? ;
source: relation join* ;
relation: (qname ('@' qname)? | '(' query ')' | 'TABLE' '(' expr ')' | '(' source ')') ('PARTITION' '(' id ')')? ('AS'? id)? ;
join: ('INNER' | ('LEFT' | 'RIGHT' | 'FULL') 'OUTER'? | 'CROSS' | 'NATURAL')? 'JOIN' relation ('ON' expr | 'USING' '(' id (',' id)* ')')? ;
where: 'WHERE' ('CURRENT' 'OF' qname | expr) ;
hierarchy: 'START' 'WITH' expr 'CONNECT' 'BY' ID? expr | 'CONNECT' 'BY' ID? expr ('START' 'WITH' expr)? ;
group: 'GROUP' 'BY' expr (',' expr)* ('HAVING' expr)? | 'HAVING' expr ;
order: 'ORDER' ID? 'BY' ordering (',' ordering)* ;
ordering: expr ('ASC' | 'DESC')? ('NULLS' ID)? ;
for_update: 'FOR' 'UPDATE' ('OF' qname (',' qname)*)? (ID NUMBER?)* ;
insert: 'INSERT' 'INTO' relation ('(' qname (',' qname)* ')')? ('VALUES' ('(' arguments ')' | target) | query) returning? ;
update: 'UPDATE' relation 'SET' (setting (',' setting)* | 'ROW' '=' expr) where? returning? ;
setting: target '=' ('DEFAULT' | expr) | '(' id (',' id)* ')' '=' '(' query ')' ;
delete: 'DELETE' 'FROM'? relation where? returning? ;
returning: ('RETURNING' | 'RETURN') expr (',' expr)* ('BULK' 'COLLECT')? 'INTO' target (',' target)* ;
merge: 'MERGE' 'INTO' relation 'USING' relation 'ON' '(' expr ')'
  ('WHEN' 'NOT'? ID 'THEN' (merge_update | 'INSERT' ('(' qname (',' qname)* ')')? 'VALUES' '(' arguments ')') where?)+ ;
merge_update: 'UPDATE' 'SET' setting (',' setting)* where? ('DELETE' where)? ;

arguments: argument (',' argument)* ;
argument: (id '=>')? ('DEFAULT' | expr | 'DISTINCT' expr | query | '*') ;
expr: operand (operator operand)* ;
operator: '+' | '-' | '*' | '/' | '**' | '||' | '=' | '<>' | '!=' | '^=' | '~=' | '<' | '>' | '<=' | '>=' | 'AND' | 'OR'
  | 'NOT'? ('LIKE' | 'IN' | 'BETWEEN' | 'MEMBER' 'OF'?) | 'ESCAPE' | 'MOD' | 'MULTISET' ('UNION' | 'INTERSECT' | ID) ('ALL' | 'DISTINCT')? ;
operand: ('+' | '-' | 'NOT' | 'PRIOR')* primary suffix* ;
suffix: 'IS' 'NOT'? ('NULL' | ID ID?) | ('=' | '<' | '>' | '<>') ('ANY' | 'ALL') '(' (query | arguments) ')' ;
primary: NUMBER | STRING+ | 'NULL' | ':' id ('.' id)* | '(' (query | arguments) ')' | reference
  | 'CASE' expr? ('WHEN' expr 'THEN' expr)+ ('ELSE' expr)? 'END' | 'EXISTS' '(' query ')' | 'CURSOR' '(' query ')' | ID STRING
  | 'REPLACE' '(' arguments ')' | '$' '$' id ;
reference: id reference_part* ('OVER' '(' window ')')? ;
reference_part: '.' ('*' | 'DELETE' | 'EXISTS' | id) | '(' arguments? ('FROM' expr)? order? ')' ('WITHIN' 'GROUP' '(' order ')')? | '%' ('TYPE' | id) | '@' qname | '(' '+' ')' ;
window: ('PARTITION' 'BY' expr (',' expr)*)? order? soup* ;
"""

VBA = r"""
file: ('NL' | ':' | heading)* module ;
heading: 'VERSION' NUMBER 'CLASS'? 'NL' | 'BEGIN' (id ('.' id)* id)? 'NL' heading_line* 'END' 'NL' ;
heading_line: 'NL' | id '=' soup+ 'NL' | 'BEGIN' (id ('.' id)* id)? 'NL' heading_line* 'END' 'NL' ;
soup: id | NUMBER | STRING | '-' | ',' | '.' | ':' | '(' | ')' | '{' | '}' | '&' | '#' ;
module: (line_end | attribute line_end | directive | module_line line_end | routine)* ;
line_end: 'NL' | ':' ;
attribute: 'ATTRIBUTE' id ('.' id)* '=' expr (',' expr)* ;
directive: '#' ('IF' expr 'THEN' | 'ELSEIF' expr 'THEN' | 'ELSE' | 'END' 'IF' | 'CONST' id '=' expr) 'NL' ;
module_line: 'OPTION' ('EXPLICIT' | 'BASE' NUMBER | 'COMPARE' ('BINARY' | 'TEXT' | 'DATABASE') | 'PRIVATE' 'MODULE')
  | 'IMPLEMENTS' id ('.' id)* | visibility? constant | visibility 'STATIC'? variables | 'DIM' variables | 'STATIC' variables
  | visibility? 'EVENT' id parameters | visibility? declare | visibility? type | visibility? enum | ID name_range (',' name_range)* ;
name_range: id ('-' id)? ;
visibility: 'PUBLIC' | 'PRIVATE' | 'GLOBAL' | 'FRIEND' ;
constant: 'CONST' id as? '=' expr (',' id as? '=' expr)* ;
variables: 'WITHEVENTS'? variable (',' variable)* ;
variable: id ('(' bounds? ')')? as? ;
bounds: bound (',' bound)* ;
bound: expr ('TO' expr)? ;
as: 'AS' 'NEW'? ('ANY' | id ('.' id)*) ('*' (NUMBER | id))? ;
declare: 'DECLARE' 'PTRSAFE'? ('SUB' | 'FUNCTION') id 'LIB' STRING ('ALIAS' STRING)? parameters? as? ;
type: 'TYPE' id 'NL' ('NL' | variable line_end)* 'END' 'TYPE' ;
enum: 'ENUM' id 'NL' ('NL' | id ('=' expr)? line_end)* 'END' 'ENUM' ;

routine: visibility? 'STATIC'? (
    'SUB' id parameters? line_end body 'END' 'SUB' line_end
  | 'FUNCTION' id parameters? (as ('(' ')')?)? line_end body 'END' 'FUNCTION' line_end
  | 'PROPERTY' ('GET' | 'LET' | 'SET') id parameters? as? line_end body 'END' 'PROPERTY' line_end ) ;
parameters: '(' (parameter (',' parameter)*)? ')' ;
parameter: 'OPTIONAL'? ('BYVAL' | 'BYREF')? 'PARAMARRAY'? id ('(' ')')? as? ('=' expr)? ;

body: (line_end | attribute line_end | directive | label | NUMBER | statement line_end)* ;
label: ID ':' ;
statement: simple | block_if | inline_if | select | for | do | while | with ;
block_if: 'IF' expr 'THEN' 'NL' body ('ELSEIF' expr 'THEN' line_end body)* ('ELSE' line_end body)? 'END' 'IF' ;
inline_if: 'IF' expr 'THEN' (inline ('ELSE' inline?)? | 'ELSE' inline) ;
inline: (simple | inline_if | NUMBER) (':' (simple | inline_if)?)* ;
select: 'SELECT' 'CASE' expr line_end line_end* ('CASE' ('ELSE' | tests) line_end body)* 'END' 'SELECT' ;
tests: test (',' test)* ;
test: expr ('TO' expr)? | 'IS'? comparison expr ;
comparison: '=' | '<' | '>' | '<>' | '<=' | '>=' | '=<' | '=>' ;
for: 'FOR' (postfix '=' expr 'TO' expr ('STEP' expr)? | 'EACH' postfix 'IN' expr) line_end body 'NEXT' (postfix (',' postfix)*)? ;
do: 'DO' (('WHILE' | 'UNTIL') expr)? line_end body 'LOOP' (('WHILE' | 'UNTIL') expr)? ;
while: 'WHILE' expr line_end body 'WEND' ;
with: 'WITH' expr line_end body 'END' 'WITH' ;
simple: 'CALL' postfix | 'LET'? postfix ('=' expr | arguments)? | ('SET' | 'LSET' | 'RSET') postfix '=' expr
  | ('DIM' | 'STATIC') variables | constant | 'REDIM' 'PRESERVE'? redim (',' redim)* | 'ERASE' postfix (',' postfix)*
  | 'EXIT' ('SUB' | 'FUNCTION' | 'PROPERTY' | 'FOR' | 'DO') | 'END' | 'STOP' | 'RETURN'
  | ('GOTO' | 'GOSUB') target | 'RESUME' ('NEXT' | target)? | 'ERROR' expr
  | 'ON' ('ERROR' ('GOTO' '-'? target | 'RESUME' 'NEXT') | expr ('GOTO' | 'GOSUB') target (',' target)*)
  | 'RAISEEVENT' id ('(' call_arguments? ')')?
  | 'OPEN' expr 'FOR' ('INPUT' | 'OUTPUT' | 'APPEND' | 'BINARY' | 'RANDOM') ('ACCESS' ('READ' | 'WRITE')+)? ('SHARED' | 'LOCK' ('READ' | 'WRITE')+)? 'AS' '#'? expr (ID '=' expr)?
  | 'CLOSE' (channel (',' channel)*)? | ('PRINT' | 'WRITE') channel (',' print_list?)? | 'PRINT' print_list? | 'INPUT' channel (',' postfix)+
  | 'LINE' 'INPUT' channel ',' postfix | ('GET' | 'PUT' ) channel ',' expr? ',' expr | 'SEEK' channel ',' expr
  | ('LOCK' | 'UNLOCK') channel (',' bound)? | 'NAME' expr 'AS' expr ;
target: ID | NUMBER | 'NEXT' ;
redim: postfix as? ;
channel: '#'? expr ;
print_list: (expr | ';' | ',')+ ;
arguments: call_argument ((',' | ';') call_argument?)* | ((',' | ';') call_argument?)+ ;
call_arguments: call_argument? (',' call_argument?)* ;
call_argument: (id ':=')? ('BYVAL' | 'ADDRESSOF')? expr ('TO' expr)? ;
expr: operand (operator operand)* ;
operator: '+' | '-' | '*' | '/' | '\\' | '^' | '&' | 'MOD' | '=' | '<>' | '<' | '>' | '<=' | '>=' | '=<' | '=>' | 'IS' | 'LIKE' | 'AND' | 'OR' | 'XOR' | 'EQV' | 'IMP' ;
operand: ('-' | '+' | 'NOT')* (NUMBER | STRING | 'NOTHING' | 'NEW' id ('.' id)* | 'TYPEOF' postfix | 'ADDRESSOF' postfix | '#' NUMBER | postfix) ;
postfix: (id | 'ME' | '(' expr ')' | '.' id | '!' id) (('.' | '!') id | '(' call_arguments ')')* ;
id: ID | 'ACCESS' | 'ALIAS' | 'APPEND' | 'BASE' | 'BEGIN' | 'BINARY' | 'CLASS' | 'COMPARE' | 'DATABASE' | 'ERROR' | 'EXPLICIT' | 'INPUT' | 'LIB'
  | 'LINE' | 'MODULE' | 'MULTIUSE' | 'NAME' | 'OUTPUT' | 'PRINT' | 'PROPERTY' | 'RANDOM' | 'READ' | 'STEP' | 'TEXT' | 'VERSION' ;
"""

PYTHON = r"""
file: ('NEWLINE' | statement)* ENDMARKER ;
statement: simple_line | compound ;
simple_line: small (';' small)* ';'? NEWLINE ;
small: expression_statement | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (expr ('from' expr)?)?
  | ('global' | 'nonlocal') name (',' name)* | 'del' deleted | 'assert' expr (',' expr)? | 'import' dotted_as (',' dotted_as)*
  | from_import | 'type' name type_parameters? '=' expr ;
dotted: name ('.' name)* ;
dotted_as: dotted ('as' name)? ;
from_import: 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | imported (',' imported)* | '(' imported (',' imported)* ','? ')') ;
imported: name ('as' name)? ;
expression_statement: stars | yield | (targets '=')+ value | single augmented value
  | (name | '(' single ')' | place) ':' expr ('=' value)? ;
value: yield | stars ;
augmented: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' ;
yield: 'yield' ('from' expr | stars)? ;

# what may be assigned to: a name, an attribute or subscript of anything, tuples and lists of such
targets: target (',' target)* ','? ;
target: '*'? plain_target ;
plain_target: place | name | '(' (plain_target | target ',' targets?)? ')' | '[' targets? ']' ;
place: atom trailer* ('.' name | '[' subscripts ']') ;
single: place | name | '(' single ')' ;
deleted: deleted_one (',' deleted_one)* ','? ;
deleted_one: place | name | '(' deleted? ')' | '[' deleted? ']' ;

compound: if | while | for | try | with | function | class | 'async' (for | with | function) | decorated | match ;
suite: simple_line | NEWLINE INDENT statement+ DEDENT ;
if: 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? ;
while: 'while' named ':' suite ('else' ':' suite)? ;
for: 'for' targets 'in' stars ':' suite ('else' ':' suite)? ;
try: 'try' ':' suite ('finally' ':' suite | (except+ | except_group+) ('else' ':' suite)? ('finally' ':' suite)?) ;
except: 'except' (expr ('as' name)?)? ':' suite ;
except_group: 'except' '*' expr ('as' name)? ':' suite ;
with: 'with' (with_item (',' with_item)* | '(' with_item (',' with_item)* ','? ')') ':' suite ;
with_item: expr ('as' target)? ;
function: 'def' name type_parameters? '(' parameters? ')' ('->' expr)? ':' suite ;
class: 'class' name type_parameters? ('(' arguments? ')')? ':' suite ;
decorated: ('@' named NEWLINE)+ (function | class | 'async' function) ;
type_parameters: '[' type_parameter (',' type_parameter)* ','? ']' ;
type_parameter: name (':' expr)? ('=' expr)? | '*' name ('=' star)? | '**' name ('=' expr)? ;

# plain parameters, then those with defaults, a slash once after at least one of them, then what follows a star
parameters: parameter (',' parameters_plain?)? | parameter '=' expr (',' parameters_default?)? | starred_parameters ;
parameters_plain: parameter (',' parameters_plain?)? | parameter '=' expr (',' parameters_default?)? | '/' (',' slashed_plain?)? | starred_parameters ;
parameters_default: parameter '=' expr (',' parameters_default?)? | '/' (',' slashed_default?)? | starred_parameters ;
slashed_plain: parameter (',' slashed_plain?)? | parameter '=' expr (',' slashed_default?)? | starred_parameters ;
slashed_default: parameter '=' expr (',' slashed_default?)? | starred_parameters ;
starred_parameters: '*' name (':' star)? (',' keyword_parameters?)? | '*' ',' parameter ('=' expr)? (',' keyword_parameters?)? | '**' parameter ','? ;
keyword_parameters: parameter ('=' expr)? (',' keyword_parameters?)? | '**' parameter ','? ;
parameter: name (':' expr)? ;

match: 'match' (star_named ',' star_nameds? | named) ':' NEWLINE INDENT case+ DEDENT ;
case: 'case' (open_patterns | pattern) ('if' named)? ':' suite ;
open_patterns: star_pattern ',' star_patterns? ;
star_patterns: star_pattern (',' star_pattern)* ','? ;
star_pattern: '*' name | pattern ;
pattern: closed ('|' closed)* ('as' captured)? ;
captured: NAME | 'match' | 'case' | 'type' ;
closed: literal | dotted ('(' class_patterns? ')')? | '(' (open_patterns | pattern)? ')' | '[' star_patterns? ']' | '{' mappings? '}' ;
literal: '-'? NUMBER (('+' | '-') IMAGINARY)? | '-'? IMAGINARY | strings | 'None' | 'True' | 'False' ;
class_patterns: pattern (',' further_patterns?)? | keyword_patterns ;
further_patterns: pattern (',' further_patterns?)? | captured '=' pattern (',' keyword_patterns?)? ;
keyword_patterns: name '=' pattern (',' keyword_patterns?)? ;
mappings: (literal | name ('.' name)+) ':' pattern (',' mappings?)? | '**' captured ','? ;

name: NAME | 'match' | 'case' | 'type' | '_' ;
stars: star (',' star)* ','? ;
star: '*' flat | expr ;
star_nameds: star_named (',' star_named)* ','? ;
star_named: '*' flat | named ;
named: name ':=' expr | expr ;
expr: lambda | logic ('if' logic 'else' expr)? ;
logic: inversion (('and' | 'or') inversion)* ;
inversion: 'not'* comparison ;
comparison: flat (compare flat)* ;
compare: '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' 'not'? ;
flat: operand (('+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^') operand)* ;
operand: ('+' | '-' | '~')* 'await'? atom trailer* ;
trailer: '.' name | '(' (named comprehension | arguments)? ')' | '[' subscripts ']' ;
subscripts: subscript (',' subscript)* ','? ;
subscript: expr? ':' expr? (':' expr?)? | '*' expr | named ;

# positional arguments, then keywords, then what may follow two stars
arguments: (named | '*' expr) (',' arguments?)? | name '=' expr (',' keyword_arguments?)? | '**' expr (',' last_arguments?)? ;
keyword_arguments: (name '=' expr | '*' expr) (',' keyword_arguments?)? | '**' expr (',' last_arguments?)? ;
last_arguments: (name '=' expr | '**' expr) (',' last_arguments?)? ;
comprehension: ('async'? 'for' targets 'in' logic ('if' logic)*)+ ;
atom: name | NUMBER | IMAGINARY | strings | 'None' | 'True' | 'False' | '...'
  | '(' (yield | named comprehension? | star_named ',' star_nameds?)? ')' | '[' (named comprehension | star_nameds)? ']'
  | '{' (pairs | expr ':' expr comprehension | star_nameds | named comprehension)? '}' ;
pairs: pair (',' pair)* ','? ;
pair: '**' flat | expr ':' expr ;

lambda: 'lambda' lambda_parameters? ':' expr ;
lambda_parameters: name (',' lambda_plain?)? | name '=' expr (',' lambda_default?)? | lambda_starred ;
lambda_plain: name (',' lambda_plain?)? | name '=' expr (',' lambda_default?)? | '/' (',' lambda_slashed_plain?)? | lambda_starred ;
lambda_default: name '=' expr (',' lambda_default?)? | '/' (',' lambda_slashed_default?)? | lambda_starred ;
lambda_slashed_plain: name (',' lambda_slashed_plain?)? | name '=' expr (',' lambda_slashed_default?)? | lambda_starred ;
lambda_slashed_default: name '=' expr (',' lambda_slashed_default?)? | lambda_starred ;
lambda_starred: '*' name (',' lambda_keyword?)? | '*' ',' name ('=' expr)? (',' lambda_keyword?)? | '**' name ','? ;
lambda_keyword: name ('=' expr)? (',' lambda_keyword?)? | '**' name ','? ;

strings: (STRING | formatted)+ | BYTES+ ;
formatted: FSTART fpart* FEND ;
fpart: FMIDDLE | '{' value '='? ('!' CONVERSION)? (':' fpart*)? '}' ;
"""
