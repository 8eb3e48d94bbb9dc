"""Grammars of the languages whose files are checked, in the notation of chart.Grammar.

They describe syntax only. Brackets must pair; names, types and duplicate declarations are not looked at.
"""

JSON = """
file: value
value: STR | NUM | 'true' | 'false' | 'null' | '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']'
pair: STR ':' value
"""

GO = """
file: 'package' ID ';' (import ';')* (top ';')*
import: 'import' (spec1 | '(' (spec1 ';')* spec1? ')')
spec1: (ID | '.')? STR
top: func | decl
decl: 'const' (cspec | '(' (cspec ';')* cspec? ')') | 'var' (vspec | '(' (vspec ';')* vspec? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')')
ids: ID (',' ID)*
cspec: ids (type? '=' exprs)?
vspec: ids (type ('=' exprs)? | '=' exprs)
tspec: ID tparams? '='? type
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: ids union
union: '~'? type ('|' '~'? type)*
func: 'func' params? ID tparams? sig block?
sig: params (params | type)?
params: '(' (param (',' param)* ','?)? ')'
param: type | ID type | ID? '...' type
name: ID ('.' ID)?
type: name ('[' type (',' type)* ','? ']')? | '*' type | '(' type ')' | ctype | 'chan' type | 'chan' '<-' type | '<-' 'chan' type | 'func' sig | 'interface' '{' (ielem ';')* ielem? '}'
ctype: '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}'
field: (ids type | '*'? name ('[' type (',' type)* ']')?) STR?
ielem: ID sig | union
block: '{' stmts '}'
stmts: (stmt? ';')* stmt?
stmt: decl | simple | 'return' exprs? | 'go' expr | 'defer' expr | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | for | switch | select | ID ':' stmt?
simple: exprs | exprs ASSIGN exprs | exprs '=' exprs | ids ':=' exprs | expr INC | expr '<-' expr
if: 'if' (simple? ';')? expr block ('else' (if | block))?
for: 'for' forhead? block
forhead: expr | simple? ';' expr? ';' simple? | (exprs '=' | ids ':=')? 'range' expr
switch: 'switch' (simple? ';')? simple? '{' clause* '}'
clause: ('case' caseval (',' caseval)* | 'default') ':' stmts
caseval: expr | type
select: 'select' '{' (('case' simple | 'default') ':' stmts)* '}'
exprs: expr (',' expr)*
expr: unary (binop unary)*
binop: BIN | UN | '*' | '|'
unary: ('!' | '*' | '<-' | UN | '~' NEVER) unary | primary
primary: operand | primary '.' ID | primary '.' '(' type ')' | primary '.' '(' 'type' ')' | primary '[' index ']' | primary '(' args ')' | literal
literal: (name ('[' type (',' type)* ']')? | ctype) '{' elems '}'
operand: LIT | STR | ID | '(' expr ')' | 'func' sig block | conv '(' expr ','? ')' | '(' '*' type ')'
conv: ctype | 'chan' type | 'func' sig | 'interface' '{' (ielem ';')* ielem? '}'
index: expr | type (',' type)* | expr? ':' expr? (':' expr)?
args: ((expr | type) (',' expr)* '...'? ','?)?
elems: (elem (',' elem)* ','?)?
elem: value (':' value)?
value: expr | '{' elems '}'
"""

JAVA = """
file: (annots 'package' qn ';')? (import | ';')* (type_ | ';')* | annots 'open'? 'module' qn '{' tok* '}'
tok: ID | '.' | ',' | ';' | 'requires' | 'static'
import: 'import' 'static'? qn ('.' '*')? ';'
id: ID | CTX | 'record' | 'sealed' | 'permits' | 'yield' | 'open' | 'module' | 'requires' | 'when' | 'var' | 'non'
qn: id ('.' id)*
mods: (MOD | 'static' | 'final' | 'default' | 'synchronized' | annot | 'sealed' | 'non' '-' 'sealed')*
annots: annot*
annot: '@' qn ('(' (annval | id '=' annval (',' id '=' annval)*)? ')')?
annval: ternary | annot | '{' (annval (',' annval)* ','?)? '}'
type_: mods typedecl
typedecl: class | interface | enum | record | '@' 'interface' id classbody
class: 'class' id tparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
interface: 'interface' id tparams? ('extends' types)? ('permits' types)? classbody
enum: 'enum' id ('implements' types)? '{' (econst (',' econst)* ','?)? (';' member*)? '}'
econst: annots id ('(' args ')')? classbody?
record: 'record' id tparams? '(' (param (',' param)*)? ')' ('implements' types)? classbody
classbody: '{' member* '}'
member: ';' | 'static'? block | mods memberdecl
memberdecl: typedecl | tparams? annots (type | 'void') id '(' params ')' dims throws? (block | ';' | 'default' annval ';') | tparams? id '(' params ')' throws? block | id block | type vars ';'
throws: 'throws' types
vars: var (',' var)*
var: id dims ('=' init)?
init: expr | '{' (init (',' init)* ','?)? '}'
params: (param (',' param)*)?
param: mods type annots '...'? (id dims | (id '.')? 'this')
tparams: '<' tparam (',' tparam)* '>'
tparam: annots id ('extends' type ('&' type)*)?
types: type (',' type)*
type: annots (PRIM | ref) dims
ref: id targs? ('.' annots id targs?)*
targs: '<' (targ (',' targ)*)? '>'
targ: type | annots '?' (('extends' | 'super') type)?
dims: (annots '[' ']')*
block: '{' stmt* '}'
stmt: ';' | block | mods type vars ';' | mods (class | interface | enum | record) | sexpr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forhead ')' stmt | 'return' expr? ';' | 'break' id? ';' | 'continue' id? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block | try | switch ';'? | id ':' stmt
forhead: (sexpr (',' sexpr)* | mods type vars)? ';' expr? ';' (sexpr (',' sexpr)*)? | mods type id dims ':' expr
try: 'try' block (catch+ finally? | finally) | 'try' '(' res (';' res)* ';'? ')' block catch* finally?
res: mods type id '=' expr | postfix
catch: 'catch' '(' mods type ('|' type)* id ')' block
finally: 'finally' block
switch: 'switch' '(' expr ')' '{' (label ':' stmt* | label '->' (expr ';' | block | 'throw' expr ';'))* '}'
label: 'case' caseval (',' caseval)* guard? | 'default'
caseval: ternary | pattern | 'default'
guard: 'when' expr
pattern: mods type id | type '(' (pattern (',' pattern)*)? ')' id?
sexpr: lhs assignop expr | INC unary | postfix INC | call | new
call: (primary '.' targs?)? (id | 'this' | 'super') '(' args ')' | primary '.' new
expr: ternary | lhs assignop expr | lambda
assignop: '=' | ASSIGN | '>' '>=' | '>' '>' '>='
lambda: (id | '(' (id (',' id)* | params) ')') '->' (expr | block)
lhs: id | primary '.' id | primary '[' expr ']' | '(' lhs ')'
ternary: bin ('?' expr ':' (ternary | lambda))?
bin: unary (binop unary | 'instanceof' ('final'? type id? | pattern))*
binop: BIN | '<' | '>' | '&' | '|' | '-' | '+' | '*' | '>' '>' | '>' '>' '>' | '>='
unary: (UN | '+' | '-' | INC) unary | postfix | '(' type ('&' type)* ')' (unary | lambda)
postfix: primary INC*
primary: LIT | STR | id | 'this' | 'super' | '(' expr ')' | call | primary '.' (id | 'this' | 'class' | 'super') | primary '[' expr ']' | new | (PRIM | ref) dims '.' 'class' | 'void' '.' 'class' | (primary | type) '::' targs? (id | 'new') | switch
new: 'new' targs? annots (PRIM | ref) ('(' args ')' classbody? | '[' expr ']' ('[' expr ']')* dims | '[' ']' dims '{' (init (',' init)* ','?)? '}')
args: (expr (',' expr)*)?
"""

TYPESCRIPT = """
file: stmt*
id: ID | CTX | 'async' | 'get' | 'set' | 'of' | 'from' | 'as' | 'static' | 'type' | 'interface' | 'namespace' | 'declare' | 'abstract' | 'readonly' | 'is' | 'keyof' | 'infer' | 'asserts' | 'satisfies' | 'accessor' | 'unique' | 'target' | 'implements' | 'module'
name: id | WORD | 'in' | 'new' | 'if' | 'for' | 'else' | 'while' | 'do' | 'return' | 'var' | 'let' | 'const' | 'function' | 'class' | 'import' | 'export' | 'default' | 'this' | 'super' | 'extends' | 'switch' | 'case' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally' | 'typeof' | 'void' | 'delete' | 'await' | 'yield' | 'instanceof' | 'enum' | 'null' | 'debugger'
block: '{' stmt* '}'
stmt: block | ';' | vars ';' | exprsS ';' | 'if' '(' exprs ')' stmt ('else' stmt)? | 'do' stmt 'while' '(' exprs ')' ';'? | 'while' '(' exprs ')' stmt | 'for' 'await'? '(' forhead ')' stmt | 'continue' id? ';' | 'break' id? ';' | 'return' exprs? ';' | 'throw' exprs ';' | 'debugger' ';' | id ':' stmt | 'switch' '(' exprs ')' '{' (('case' exprs | 'default') ':' stmt*)* '}' | try | func | class | import | export | tsstmt
try: 'try' block (catch finally? | finally)
catch: 'catch' ('(' target typeann? ')')? block
finally: 'finally' block
vars: ('var' | 'let' | 'const') var (',' var)*
var: id '!'? typeann? ('=' assign)? | pattern typeann? '=' assign
forhead: (vars | exprs)? ';' exprs? ';' exprs? | (('var' | 'let' | 'const') target | lhs) ('of' assign | 'in' exprs)
func: 'async'? 'function' '*'? id tparams? '(' params ')' rettype? (block | tsend)
params: (param (',' param)* ','?)?
param: decos '...'? paccess (target | 'this') optmark typeann? ('=' assign)?
target: id | pattern
pattern: '{' (pprop (',' pprop)* ','?)? '}' | '[' ','* (pelem (','+ pelem)* ','*)? ']'
pprop: id ('=' assign)? | pname ':' target ('=' assign)? | '...' target
pelem: '...'? target ('=' assign)?
pname: name | STR | LIT | '[' assign ']'
class: decos tsabstract 'class' id? tparams? ('extends' lhs targs?)? tsimpl '{' (member | ';')* '}'
decos: ('@' lhs)*
member: decos macc* ('async'? '*'? | 'get' | 'set') mname optmark tparams? '(' params ')' rettype? (block | tsend) | decos macc* mname fmark typeann? ('=' assign)? ';' | 'static' block | tsindex
macc: 'static' | 'accessor' | tsacc
mname: pname | PRIVATE
import: 'import' STR attrs? ';' | 'import' tstype (id | names | '*' 'as' id | id ',' (names | '*' 'as' id)) 'from' STR attrs? ';' | tsimport
attrs: ('with' | 'assert') '{' (pname ':' STR (',' pname ':' STR)* ','?)? '}'
names: '{' (iname (',' iname)* ','?)? '}'
iname: tstype (name | STR) ('as' (name | STR))?
export: decos 'export' (vars ';' | func | class | tsstmt) | 'export' 'default' (func | class | 'async'? 'function' '*'? '(' params ')' rettype? block | assign ';' | tsstmt) | 'export' tstype names ('from' STR attrs?)? ';' | 'export' tstype '*' ('as' (name | STR))? 'from' STR attrs? ';' | tsexport
exprs: assign (',' assign)*
exprsS: assignS (',' assign)*
assign: cond | lhs ('=' | ASSIGN | '>' '>=' | '>' '>' '>=') assign | pattern '=' assign | arrow | 'yield' ('*'? assign)?
assignS: condS | lhsS ('=' | ASSIGN | '>' '>=' | '>' '>' '>=') assign | arrayS '=' assign | arrow | 'yield' ('*'? assign)?
arrayS: '[' ','* (pelem (','+ pelem)* ','*)? ']'
arrow: 'async'? (id | tparams? '(' params ')' rettype?) '=>' (assignB | block)
assignB: condS | lhsS ('=' | ASSIGN) assign | arrow | func1 | class | arrayS '=' assign | 'yield' assign?
func1: 'async'? 'function' '*'? id? '(' params ')' rettype? block
cond: bin ('?' assign ':' assign)?
condS: binS ('?' assign ':' assign)?
bin: unary tail*
binS: unaryS tail*
tail: binop unary | tsas
binop: BIN | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' | '&' | '|' | '-' | '+' | '*' | 'in' | 'instanceof'
unary: ('!' | UN | '-' | '+' | INC | 'typeof' | 'void' | 'delete' | 'await') unary | postfix | PRIVATE 'in' unary | tscast
unaryS: ('!' | UN | '-' | '+' | INC | 'typeof' | 'void' | 'delete' | 'await') unary | postfixS
postfix: lhs INC?
postfixS: lhsS INC?
lhs: primary | lhs suffix | 'new' lhs | 'super' suffix | 'import' '(' exprs ','? ')' | 'import' '.' name | 'new' '.' 'target'
lhsS: primaryS | lhsS suffix | 'new' lhs | 'super' suffix | 'import' '(' exprs ','? ')' | 'import' '.' name
suffix: '.' (name | PRIVATE) | '?.' (name | PRIVATE | '(' args ')' | '[' exprs ']' | TEMPLATE) | '[' exprs ']' | '(' args ')' | TEMPLATE | tssuffix
primary: primaryS | '{' (prop (',' prop)* ','?)? '}' | 'async'? 'function' '*'? id? tparams? '(' params ')' rettype? block | class
primaryS: id | LIT | 'null' | STR | 'this' | REGEX | TEMPLATE | '(' exprs ')' | '[' ','* (elem (','+ elem)* ','*)? ']'
elem: '...'? assign
args: (elem (',' elem)* ','?)?
prop: id ('=' assign)? | pname ':' assign | ('async'? '*'? | 'get' | 'set') pname tparams? '(' params ')' rettype? block | '...' assign
tsstmt: 'declare'? 'interface' id tparams? ('extends' type (',' type)*)? tbody | 'declare'? 'type' id tparams? '=' type ';' | 'declare'? 'const'? 'enum' id '{' (pname ('=' assign)? (',' pname ('=' assign)?)* ','?)? '}' | 'declare'? ('namespace' | 'module') (id ('.' id)* | STR) (block | ';') | 'declare' (vars ';' | func | class) | 'declare' id block
tsend: ';'
paccess: (TSACC | 'readonly')*
optmark: '?'?
fmark: ('?' | '!')?
typeann: ':' type
rettype: ':' type | ':' 'asserts' (id | 'this') ('is' type)? | ':' (id | 'this') 'is' type
tsabstract: 'abstract'?
tsimpl: ('implements' type (',' type)*)?
tsacc: TSACC | 'readonly' | 'abstract' | 'declare'
tsindex: macc* '[' id ':' type ']' typeann ';'
tstype: 'type'?
tsimport: 'import' id '=' lhs ';'
tsexport: 'export' '=' assign ';' | 'export' 'as' 'namespace' id ';'
tsas: 'as' (type | 'const') | 'satisfies' type
tscast: '<' type '>' unary
tssuffix: '!' | targs '(' args ')' | targs TEMPLATE
tparams: '<' tparam (',' tparam)* ','? '>'
tparam: 'const'? 'in'? id ('extends' type)? ('=' type)?
targs: '<' type (',' type)* '>'
tbody: '{' ((tmember (';' | ','))* tmember?) '}'
tmember: tacc pname '?'? typeann? | tacc ('get' | 'set')? pname '?'? tparams? '(' params ')' rettype? | 'new'? tparams? '(' params ')' rettype? | ('-' | '+')? 'readonly'? '[' id (':' type | 'in' type ('as' type)?) ']' (('-' | '+')? '?')? typeann?
tacc: 'readonly'?
type: union | union 'extends' union '?' type ':' type | fn
fn: tsabstract 'new'? tparams? '(' params ')' '=>' (type | (id | 'this') 'is' type | 'asserts' id ('is' type)?)
union: '|'? inter ('|' (inter | fn))*
inter: '&'? tpre ('&' tpre)*
tpre: ('keyof' | 'unique' | 'readonly' | 'infer') tpre | tpost
tpost: tprim | tpost '[' ']' | tpost '[' type ']'
tprim: '(' type ')' | tname targs? | STR | '-'? LIT | 'null' | TEMPLATE | 'typeof' (tname | 'import' '(' STR ')') targs? | tbody | '[' (tuple (',' tuple)* ','?)? ']' | 'this' | 'void' | 'import' '(' STR ')' ('.' name)* targs?
tname: id ('.' name)*
tuple: '...'? (type | id '?'? ':' type) '?'?
"""

_JS_ONLY = {
    "tsstmt": "NEVER", "tsend": "NEVER", "paccess": "", "optmark": "", "fmark": "", "typeann": "NEVER", "rettype": "NEVER", "tsabstract": "", "tsimpl": "", "tsacc": "NEVER",
    "tsindex": "NEVER", "tstype": "", "tsimport": "NEVER", "tsexport": "NEVER", "tsas": "NEVER", "tscast": "NEVER", "tssuffix": "NEVER", "tparams": "NEVER", "targs": "NEVER",
}
JAVASCRIPT = "\n".join(
    f"{n}: {_JS_ONLY[n]}" if (n := line.partition(":")[0].strip()) in _JS_ONLY else line for line in TYPESCRIPT.strip().splitlines()
)

RUST = """
file: inner* item*
inner: '#' '!' '[' tts ']'
attr: '#' '[' tts ']'
tts: (ANY | '(' tts ')' | '[' tts ']' | '{' tts '}')*
group: '(' tts ')' | '[' tts ']' | '{' tts '}'
id: ID | CTX | 'union' | 'macro_rules' | 'auto' | 'default'
item: attr* vis? kind
vis: 'pub' ('(' tts ')')?
kind: fn | struct | 'union' id generics? where? '{' fields '}' | enum | impl | trait | 'mod' id (';' | '{' inner* item* '}') | 'use' tree ';' | ('const' | 'static' 'mut'?) (id | '_') ':' type ('=' expr)? ';' | 'type' id generics? (':' bounds)? where? ('=' type)? where? ';' | 'extern' 'crate' (id | 'self') ('as' (id | '_'))? ';' | 'unsafe'? 'extern' STR? '{' inner* item* '}' | 'macro_rules' '!' id group ';'? | macroitem
macroitem: path '!' id? ('{' tts '}' | ('(' tts ')' | '[' tts ']') ';')
tree: ((seg0 '::')* | '::') (seg0 ('as' (id | '_'))? | '*' | '{' (tree (',' tree)* ','?)? '}') | '::' (seg0 '::')* (seg0 | '*' | '{' (tree (',' tree)* ','?)? '}')
seg0: id | 'self' | 'super' | 'crate' | 'Self'
fn: ('default' | 'const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' id generics? '(' (fparam (',' fparam)* ','?)? ')' ('->' type)? where? (block | ';')
fparam: attr* (('&' LIFE?)? 'mut'? 'self' (':' type)? | pat ':' type | '...' | type)
generics: '<' (gparam (',' gparam)* ','?)? '>'
gparam: attr* (LIFE (':' bounds?)? | id (':' bounds?)? ('=' type)? | 'const' id ':' type ('=' (block | '-'? LIT | id))?)
where: 'where' (wpred (',' wpred)* ','?)?
wpred: LIFE ':' bounds? | ('for' generics)? type ':' bounds?
bounds: bound ('+' bound)* '+'?
bound: LIFE | '?'? ('for' generics)? tpath | '(' bound ')'
struct: 'struct' id generics? (where? '{' fields '}' | '(' (attr* vis? type (',' attr* vis? type)* ','?)? ')' where? ';' | where? ';')
fields: (field (',' field)* ','?)?
field: attr* vis? id ':' type
enum: 'enum' id generics? where? '{' (variant (',' variant)* ','?)? '}'
variant: attr* vis? id ('{' fields '}' | '(' (attr* vis? type (',' attr* vis? type)* ','?)? ')')? ('=' expr)?
impl: 'default'? 'unsafe'? 'impl' generics? ('!'? type 'for')? type where? '{' inner* item* '}'
trait: 'unsafe'? 'auto'? 'trait' id generics? (':' bounds?)? where? '{' inner* item* '}'
type: tpath | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | '(' (type (',' type)* ','?)? ')' | ('impl' | 'dyn') bounds | '!' | '_' | ('for' generics)? ('unsafe' | 'extern' STR?)* 'fn' '(' (attr* ((id | '_') ':')? type (',' attr* ((id | '_') ':')? type)* ','?)? ')' ('->' type)? | tpath '!' group | 'for' generics tpath
tpath: '::'? tseg ('::' tseg)* | '<' type ('as' tpath)? '>' ('::' tseg)+
tseg: seg0 ('::'? gargs | '(' (type (',' type)* ','?)? ')' ('->' type)?)?
gargs: '<' (garg (',' garg)* ','?)? '>'
garg: LIFE | type | id gargs? '=' type | id ':' bounds | '-'? LIT | STR | block
block: '{' inner* stmts '}'
stmts: stmt* expr?
stmt: ';' | item | attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | attr* blocky | attr* expr ';' | path '!' '{' tts '}'
blocky: block | 'unsafe' block | 'async' 'move'? block | 'const' block | if | match | (LIFE ':')? ('loop' block | 'while' expr block | 'for' pat 'in' expr block | block)
if: 'if' expr block ('else' (if | block))?
match: 'match' expr '{' inner* (arm* lastarm?) '}'
arm: attr* '|'? pat ('if' expr)? '=>' (expr ',' | blocky ','?)
lastarm: attr* '|'? pat ('if' expr)? '=>' expr
expr: unary (binop unary | 'as' type | range unary?)* | range (unary (binop unary | 'as' type)*)?
range: '..' | '..='
binop: BIN | '+' | '<' | '>' | '<' '<' | '>' '>' | '<' '<=' | '>' '>=' | '<=' | '>=' | '&' | '&&' | '|' | '||' | '*' | '-' | '=' | ASSIGN
unary: ('-' | '*' | '!' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' NEVER) unary | post | 'let' pat '=' unary | closure | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | 'yield' expr?
closure: 'static'? 'async'? 'move'? ('||' | '|' (pat1 (':' type)? (',' pat1 (':' type)?)* ','?)? '|') (expr | '->' type block)
post: primary | post '.' (id | 'await' | LIT | 'self' NEVER) ('::' gargs)? | post '(' args ')' | post '[' expr ']' | post '?'
args: (attr* expr (',' attr* expr)* ','?)?
primary: LIT | STR | path | '(' (attr* expr (',' expr)* ','?)? ')' | '[' (expr (',' expr)* ','? | expr ';' expr)? ']' | path '{' (fieldx (',' fieldx)* ','?)? ('..' expr?)? '}' | path '!' group | blocky
fieldx: attr* ((id | LIT) ':' expr | id)
path: '::'? pseg ('::' pseg)* | '<' type ('as' tpath)? '>' ('::' pseg)+
pseg: seg0 ('::' gargs)?
pat: '|'? pat1 ('|' pat1)*
pat1: '_' | '..' | ('ref'? 'mut'? id ('@' pat1)?) | '-'? LIT | STR | path | prange | '&' 'mut'? pat1 | '&&' 'mut'? pat1 | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']' | path '(' (pat (',' pat)* ','?)? ')' | path '{' (attr* fieldp (',' attr* fieldp)* ','?)? '}' | path '!' group | 'const' block
prange: pend? ('..' | '..=' | '...') pend?
pend: '-'? LIT | path
fieldp: (id | LIT) ':' pat | 'ref'? 'mut'? id | '..'
"""

PYTHON = """
file: NEWLINE* stmt*
stmt: simple NEWLINE | compound
simple: small (';' small)* ';'?
small: stars | single augop (stars | yield) | single ann | chain | 'return' stars? | 'import' dotted ('as' id)? (',' dotted ('as' id)?)* | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | inames | '(' inames ','? ')') | 'raise' (test ('from' test)?)? | 'pass' | 'del' dels | 'yield' yieldrest | 'assert' test (',' test)? | 'break' | 'continue' | 'global' id (',' id)* | 'nonlocal' id (',' id)* | 'type' id tparams? '=' test
single: id | place | '(' single ')'
place: primary '.' id | primary '[' subs ']'
tgt: id | place | '(' tgts? ')' | '[' tgts? ']'
tgts: '*'? tgt (',' '*'? tgt)* ','?
dels: tgt (',' tgt)* ','?
ann: ':' test ('=' (stars | yield))?
chain: (tgts '=')+ (stars | yield)
augop: AUG
inames: id ('as' id)? (',' id ('as' id)?)*
id: ID | 'match' | 'case' | 'type' | '_'
dotted: id ('.' id)*
yield: 'yield' yieldrest
yieldrest: ('from' test | stars)?
compound: 'if' named ':' suite ('elif' named ':' suite)* else? | 'while' named ':' suite else? | 'async'? 'for' tgts 'in' stars ':' suite else? | 'try' ':' suite (('except' ('*'? test ('as' id)?)? ':' suite)+ else? ('finally' ':' suite)? | 'finally' ':' suite) | 'async'? 'with' withs ':' suite | decos ('async'? 'def' id tparams? '(' params ')' ('->' test)? ':' suite | 'class' id tparams? ('(' cargs ')')? ':' suite) | 'match' stars ':' NEWLINE INDENT ('case' pats ('if' named)? ':' suite)+ DEDENT
decos: ('@' named NEWLINE)*
else: 'else' ':' suite
suite: simple NEWLINE | NEWLINE INDENT stmt+ DEDENT
withs: with (',' with)* | '(' with (',' with)* ','? ')'
with: test ('as' '*'? tgt)?
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: ('*' | '**')? id (':' test)? ('=' test)?
params: ((paramhead | paramtail | paramhead ',' paramtail) ','?)?
param: id (':' test)?
paramd: param '=' test
paramps: param (',' param)*
paramds: paramd (',' paramd)*
paramhead: paramps (',' paramds)? | paramds | paramps ',' '/' (',' paramps)? (',' paramds)? | (paramps ',')? paramds ',' '/' (',' paramds)?
paramtail: '*' id (':' '*'? test)? (',' (param | paramd))* (',' paramkw)? | '*' (',' (param | paramd))+ (',' paramkw)? | paramkw
paramkw: '**' param
lparams: ((lparamhead | lparamtail | lparamhead ',' lparamtail) ','?)?
lparam: id
lparamd: lparam '=' test
lparamps: lparam (',' lparam)*
lparamds: lparamd (',' lparamd)*
lparamhead: lparamps (',' lparamds)? | lparamds | lparamps ',' '/' (',' lparamps)? (',' lparamds)? | (lparamps ',')? lparamds ',' '/' (',' lparamds)?
lparamtail: '*' id (',' (lparam | lparamd))* (',' lparamkw)? | '*' (',' (lparam | lparamd))+ (',' lparamkw)? | lparamkw
lparamkw: '**' lparam
stars: star (',' star)* ','?
star: '*' bin | test
named: test | id ':=' test | '*' bin NEVER
test: bin ('if' bin 'else' test)? | 'lambda' lparams ':' test
bin: unary (binop unary)*
binop: BIN | '+' | '|' | '*' | '**' | '-' | '/' | '@' | 'in' | 'not' 'in' | 'is' 'not'? | 'and' | 'or'
unary: ('-' | UN | '+' | 'not') unary | 'await'? primary
primary: atom | primary '.' id | primary '(' args ')' | primary '[' subs ']'
atom: id | LIT | strs | '...' | '(' (yield | genitems)? ')' | '[' genitems? ']' | '{' (genitems | kvs)? '}'
genitems: item (',' item)* ','? | item comp+
item: '*' bin | named
kvs: kv (',' kv)* ','? | test ':' test comp+
kv: test ':' test | '**' bin
comp: 'async'? 'for' tgts 'in' bin ('if' 'not'? cond)* | 'async'? 'for' tgts 'in' bin NEVER
cond: named
args: cargs | named comp+
cargs: (pos (',' pos)* (',' kws)? ','? | kws ','?)?
pos: named | '*' test
kwa: id '=' test
kwb: '**' test (',' (kwa | '**' test))*
kws: kwa (',' (kwa | '*' test))* (',' kwb)? | kwb
subs: sub (',' sub)* ','?
sub: named | '*' bin | test? ':' test? (':' test?)?
pats: pat (',' pat)* ','?
pat: pat1 ('|' pat1)* ('as' id)? | '*' id
strs: STR+ | BYTES+
num: '-'? LIT (('+' | '-') LIT)?
pat1: num | strs | dotted | dotted '(' ((pat | id '=' pat) (',' (pat | id '=' pat))* ','?)? ')' | '(' pats? ')' | '[' pats? ']' | '{' ((kpat | '**' id) (',' (kpat | '**' id))* ','?)? '}'
kpat: (num | strs | dotted) ':' pat
"""

YAML = """
file: docs
docs: doc? (MARK doc?)*
doc: node
node: map | seq | props NEWLINE (map | seq) | leaf | INDENT node DEDENT
props: (ANCHOR | TAG)+
leaf: props? (PLAIN | QUOTED | BLOCK | flow) NEWLINE cont? | ANCHOR NEWLINE | TAG NEWLINE | ALIAS NEWLINE
cont: INDENT (PLAIN NEWLINE)+ DEDENT | (PLAIN NEWLINE)+
map: entry+
entry: KEY value | QKEY value | flow ':' NEVER
value: NEWLINE INDENT node DEDENT | NEWLINE seq | NEWLINE | props NEWLINE (INDENT node DEDENT | seq)? | props? (PLAIN NEWLINE more? | (QUOTED | BLOCK | flow) NEWLINE) | ALIAS NEWLINE
more: INDENT (PLAIN NEWLINE)+ DEDENT
seq: elem+
elem: DASH INDENT node DEDENT | DASH NEWLINE (INDENT node DEDENT)?
flow: '{' fmap '}' | '[' fseq ']'
fmap: (fpair (',' fpair)* ','?)?
fpair: fval (':' fval?)? | ':' fval?
fseq: (fpair (',' fpair)* ','?)?
fval: props? (FPLAIN | FQUOTED | flow | ALIAS) | props
"""
