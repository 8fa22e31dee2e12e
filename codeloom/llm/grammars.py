"""Grammars of seven languages for the engine in ``peg``.

They decide syntactic validity only: names and types are not checked, operators
have no precedence (it can't make a text invalid), and the inside of macros is
only required to balance.
"""

from __future__ import annotations

from functools import lru_cache

from codeloom.lex.scanner import scanner
from codeloom.llm.peg import Grammar

PYTHON = r"""
File <- Stmt*
%name = IDENT 'type' 'match' 'case'
%binop = 'and' 'or' '==' '!=' '<' '>' '<=' '>=' '|' '^' '&' '<<' '>>' '+' '-' '*' '/' '//' '%' '@' '**'
%unary = '-' '+' '~' 'not' 'await'
%augop = '+=' '-=' '*=' '/=' '//=' '%=' '@=' '&=' '|=' '^=' '>>=' '<<=' '**='
Stmt <- 'if' Named ':' Block ('elif' Named ':' Block)* Else? / 'while' Named ':' Block Else? / 'for' For / 'try' Try / 'with' With / 'def' Def / 'class' Class
  / 'async' ('def' Def / 'for' For / 'with' With) / Decorated / Match / Simple
Else <- 'else' ':' Block
Block <- NL @:Stmts / Simple
Stmts <- Stmt+
Simple <- Small (';' Small)* ';'? NL
Small <- 'pass' / 'break' / 'continue' / 'return' Exprs? / 'raise' (Expr ('from' Expr)?)? / ('global' / 'nonlocal') name (',' name)* / 'del' Targets
  / 'assert' Expr (',' Expr)? / 'import' Module (',' Module)* / 'from' From / TypeAlias / ExprStmt
Module <- Dotted ('as' name)?
Dotted <- name ('.' name)*
From <- (('.' / '...')+ Dotted? / Dotted) 'import' ('*' / @(Imported) / Import1 (',' Import1)*)
Imported <- Import1 (',' Import1)* ','?
Import1 <- name ('as' name)?
TypeAlias <- 'type' name TypeParams? '=' Expr
TypeParams <- @[TypeParamList]
TypeParamList <- TypeParam (',' TypeParam)* ','?
TypeParam <- ('*' / '**')? name (':' Expr)? ('=' Expr)?
ExprStmt <- Single (':' Expr ('=' Exprs)? / augop Exprs) / (Targets '=')* Exprs
Exprs <- 'yield' ('from' Expr / Exprs?) / Expr (',' Plain)* ','? / '*' Or ',' (Plain (',' Plain)* ','?)?
Plain <- '*' Or / Expr
Star <- '*' Or / 'yield' ('from' Expr / Exprs?) / Named
Named <- name ':=' Expr / Expr
Expr <- 'lambda' LambdaParams? ':' Expr / Or ('if' Or 'else' Expr)?
LambdaParams <- LPos (',' LStar)? ','? / LStar ','?
LPos <- LBare (',' LBare)* (',' '/' (',' LBare)* (',' LDef)* / (',' LDef)+ (',' '/' (',' LDef)*)?)? / LDef (',' LDef)* (',' '/' (',' LDef)*)?
LBare <- name !'='
LDef <- name '=' Expr
LStar <- '*' name (',' LKey)* (',' '**' name)? / '*' (',' LKey)+ (',' '**' name)? / '**' name
LKey <- name ('=' Expr)?
Or <- Unary (BinOp Unary)*
BinOp <- binop / 'in' / 'not' 'in' / 'is' 'not'?
Unary <- unary* Primary
Primary <- Atom Trailer*
Trailer <- '.' name / @(Args) / @[Subs]
Atom <- name / NUM / (STR (@"Hole)*)+ / CHAR+ / 'None' / 'True' / 'False' / '...' / @(Paren) / @[ListIn] / @{DictIn}
Hole <- Exprs '='?
Paren <- ('*' Or ',' (Star (',' Star)* ','?)? / Star (CompFor / (',' Star)* ','?))?
ListIn <- (Star (CompFor / (',' Star)* ','?))?
DictIn <- ('**' Or (',' Pair)* ','? / '*' Or (',' Star)* ','? / Named (':' Expr (CompFor / (',' Pair)* ','?) / CompFor / (',' Star)* ','?))?
Pair <- '**' Or / Expr ':' Expr
Args <- (PosArg (CompFor &END / (',' PosArg)* (',' KeyArgs)? (',' LastArgs)? ','?) / KeyArgs (',' LastArgs)? ','? / LastArgs ','?)?
PosArg <- '*' Expr / !(name '=') Named
KeyArgs <- KeyArg (',' KeyArg)*
KeyArg <- name '=' Expr / '*' Expr
LastArgs <- LastArg (',' LastArg)*
LastArg <- name '=' Expr / '**' Expr
Subs <- Sub (',' Sub)* ','?
Sub <- Expr? ':' Expr? (':' Expr?)? / Star
CompFor <- ('async'? 'for' Targets 'in' Or ('if' (Or (':=' Expr)?))*)+
Targets <- Target (',' Target)* ','?
Target <- '*'? (Place / name / @(TargetParen) / @[TargetList])
Place <- Atom (Trailer &('.' / '(' / '['))* ('.' name / @[Subs])
Single <- Place / name / @(Single)
TargetParen <- (Target (',' Target)+ ','? / Target ',' / !'*' Target)?
TargetList <- Targets?
For <- Targets 'in' Exprs ':' Block Else?
Try <- ':' Block ((Except+ Bare? / Bare) Else? Finally? / Finally)
Except <- 'except' '*'? Expr ('as' name)? ':' Block
Bare <- 'except' ':' Block
Finally <- 'finally' ':' Block
With <- (@(WithParen) ':' / WithItem (',' WithItem)* ':') Block
WithParen <- WithItem (',' WithItem)* ','?
WithItem <- Expr ('as' Target)?
Def <- name TypeParams? @(Params) ('->' Exprs)? ':' Block
Params <- (PPos (',' PStar)? ','? / PStar ','?)?
PPos <- PBare (',' PBare)* (',' '/' (',' PBare)* (',' PDef)* / (',' PDef)+ (',' '/' (',' PDef)*)?)? / PDef (',' PDef)* (',' '/' (',' PDef)*)?
PBare <- name (':' Expr)? !'='
PDef <- name (':' Expr)? '=' Expr
PStar <- '*' name (':' Plain)? (',' PKey)* (',' PLast)? / '*' (',' PKey)+ (',' PLast)? / PLast
PKey <- name (':' Expr)? ('=' Expr)?
PLast <- '**' name (':' Expr)?
Class <- name TypeParams? @(Args)? ':' Block
Decorated <- ('@' Named NL)+ ('def' Def / 'class' Class / 'async' 'def' Def)
Match <- 'match' Exprs ':' NL @:Cases
Cases <- Case+
Case <- 'case' Pattern (',' Pattern)* ','? ('if' Named)? ':' Block
Pattern <- '*' name / Or ('as' name)?
"""

_JS = r"""
File <- Stmt*
Stmts <- Stmt*
%id = IDENT 'as' 'async' 'from' 'get' 'let' 'of' 'set' 'static' TYPE_WORDS
%name = IDENT WORDS
%arith = '==' '!=' '===' '!==' '<' '<=' '<<' '+' '-' '*' '/' '%' '**' '&' '|' '^' 'in' 'instanceof'
%assign = '=' '+=' '-=' '*=' '/=' '%=' '**=' '<<=' '&=' '|=' '^=' '&&=' '||=' '??='
%prefix = '!' '~' '+' '-' 'typeof' 'void' 'delete'
%pre = 'await' 'new'
%target = id TARGET_MARK
%callee = id 'this' 'super' TEMPLATE ')' ']'
%lexical = IDENT '[' '{'
%mod = 'static' 'async' 'get' 'set' '*' MOD_WORDS
Stop <- (';' / SOFT)+ / END
Stmt <- ';' / SOFT / Block / VarDecl Stop / FuncDecl / ClassDecl / 'if' @(Exprs) Sub (SOFT? 'else' Sub)? / 'for' 'await'? @(ForHead) Sub / 'while' @(Exprs) Sub
  / 'do' Sub SOFT? 'while' @(Exprs) ';'? / 'return' Exprs? Stop / ('break' / 'continue') id? Stop / 'throw' Exprs Stop / 'try' Try / 'switch' @(Exprs) SOFT? @{Cases}
  / 'debugger' Stop / 'import' Import / 'export' Export / Decorator SOFT? Stmt / TypeStmt / id ':' Stmt / !('{' / 'function' / 'class' / 'async' 'function' / 'let' '[') Exprs Stop
Sub <- SOFT? !('const' / 'class' / 'let' lexical) Stmt
Block <- @{Stmts}
VarDecl <- ('var' / 'let') Var (',' Var)* / 'const' Const (',' Const)*
Var <- id '!'? Ann? ('=' Expr)? / Pattern Ann? '=' Expr
Const <- id '!'? Ann? CONST_INIT / Pattern Ann? '=' Expr
Pattern <- id / @{ObjItems} / @[ArrayItems]
ForHead <- ('var' / 'let' / 'const') Pattern Ann? ('of' Expr / 'in' Exprs) / Postfix ASSIGNABLE ('of' Expr / 'in' Exprs) / (VarDecl / Exprs)? ';' Exprs? ';' Exprs?
Try <- SOFT? Block (SOFT? 'catch' @(Catch)? SOFT? Block (SOFT? 'finally' SOFT? Block)? / SOFT? 'finally' SOFT? Block)
Catch <- Pattern Ann?
Cases <- SOFT? (('case' Exprs / 'default') ':' CaseStmt*)*
CaseStmt <- !('case' / 'default' ':') Stmt
FuncDecl <- 'async'? 'function' '*'? id TypeParams? @(Params) Ret? (SOFT? Block / OVERLOAD)
FuncExpr <- 'async'? 'function' '*'? id? TypeParams? @(Params) Ret? SOFT? Block
Params <- (Param (',' Param)* (',' Rest / ',')? / Rest)?
Rest <- Decorator* PARAM_MODS '...' Pattern '?'? Ann?
Param <- Decorator* PARAM_MODS (Pattern / 'this') '?'? Ann? ('=' Expr)?
ClassDecl <- ABSTRACT 'class' id? TypeParams? ('extends' Postfix TypeArgs?)? Implements? SOFT? @{Members}
Members <- (';' / SOFT / Decorator / Member)*
Member <- 'static' SOFT? Block / (mod !('=' / ';' / ':' / '?' / '!' / SOFT / END / OPEN_PAREN / '<'))* (IndexSig / PropName ('?' / '!')? (TypeParams? @(Params) Ret? (SOFT? Block / Stop) / Ann? ('=' Expr)? Stop))
PropName <- '#'? name / STR / NUM / @[Expr]
Decorator <- '@' Postfix
Import <- (@(Expr) / '.' name) Trailer* ImportRest Stop / TYPE_ONLY STR ImportWith? Stop / TYPE_ONLY ImportClause 'from' STR ImportWith? Stop / IMPORT_EQ
ImportRest <- (BinOp Unary)*
ImportWith <- ('with' / IDENT) @{ObjItems}
ImportClause <- Names / '*' 'as' id / id (',' ('*' 'as' id / Names))?
Names <- @{NameList}
NameList <- (NameItem (',' NameItem)* ','?)?
NameItem <- TYPE_NAME (name / STR) ('as' (name / STR))?
Export <- 'default' (FuncExpr / ClassDecl / TypeStmt / Expr Stop) / '*' ('as' (name / STR))? 'from' STR ImportWith? Stop / TYPE_ONLY Names ('from' STR ImportWith?)? Stop / '=' Expr Stop / EXPORT_AS
  / FuncDecl / ClassDecl / VarDecl Stop / Decorator SOFT? Export / TypeStmt
Exprs <- Expr (',' Expr)*
Expr! <- Arrow / 'yield' ('*'? Expr)? / Postfix &AssignOp ASSIGNABLE AssignOp Expr / Cond
AssignOp <- assign
Arrow <- 'async'? (TypeParams? @(Params) Ret? / id) '=>' SOFT? (Block !Trailer1 / Expr)
Trailer1 <- OPEN_PAREN / '.'
Cond <- Bin ('?' Expr ':' Expr)?
Bin <- Chain (('??' Chain)+ !('&&' / '||') / (('&&' / '||') Chain)+ !'??')?
Chain <- Unary (ArithOp Unary / TYPE_OP)*
ArithOp <- arith / '>' '>'? '>'? '='?
BinOp <- ArithOp / '&&' / '||' / '??'
Unary <- pre* (prefix (prefix / pre)* Update !'**' / Update TYPE_ASSERT)
Update <- ('++' / '--') Postfix ASSIGNABLE / Postfix (&('++' / '--') ASSIGNABLE ('++' / '--'))?
Postfix! <- Primary Trailer*
Trailer <- '.' '#'? name / '?.' (name / @[Exprs] / @(Args) / '#' name) / @[Exprs] / @(Args) / Template / NONNULL / TypeArgs &(OPEN_PAREN / TEMPLATE)
Primary <- NUM / STR / REGEX / Template / 'this' / 'super' / 'null' / 'true' / 'false' / FuncExpr / 'class' ClassExpr / id / @(Exprs) / @[ArrayItems] / @{ObjItems} / 'import' (@(Args) / '.' name) / '#' name / '.' name / Decorator Primary
ClassExpr <- id? TypeParams? ('extends' Postfix TypeArgs?)? Implements? SOFT? @{Members}
Template <- TEMPLATE (@"Exprs)*
Args <- (Arg (',' Arg)* ','?)?
Arg <- '...'? Expr
ArrayItems <- (',' / Arg (',' / END))*
ObjItems <- (ObjItem (',' ObjItem)* ','?)?
ObjItem <- '...' Expr / PropName ':' Expr / (mod !(',' / ':' / '=' / END / OPEN_PAREN))* PropName TypeParams? @(Params) Ret? SOFT? Block / id ('=' Expr)?
"""

_JS_ONLY = r"""
Ann <- NEVER
Ret <- NEVER
TypeParams <- NEVER
TypeArgs <- NEVER
Implements <- NEVER
IndexSig <- NEVER
TypeStmt <- NEVER
"""

_TS_ONLY = r"""
Ann <- ':' Type
Ret <- ':' Type
Implements <- 'implements' TypeList
TypeList <- Type (',' Type)*
IndexSig <- @[IndexIn] Ann Stop
IndexIn <- id ':' Type
TypeStmt <- 'interface' name TypeParams? ('extends' TypeList)? SOFT? @{TypeMembers} / 'type' id TypeParams? '=' SOFT? Type Stop / 'const'? 'enum' id SOFT? @{EnumItems} / 'declare' (GlobalMod / Stmt)
  / ('namespace' / 'module') (STR / id ('.' name)*) SOFT? (Block / Stop)
GlobalMod <- IDENT SOFT? Block
EnumItems <- (EnumItem (',' EnumItem)* ','?)?
EnumItem <- PropName ('=' Expr)?
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in' / IDENT &(id))* id ('extends' Type)? ('=' Type)?
TypeArgs! <- '<' Type (',' Type)* ','? '>'
Type <- ('asserts' (id / 'this') ('is' Type)? / (id / 'this') 'is' Type) / FuncType / Union ('extends' Union '?' Type ':' Type)?
FuncType <- 'abstract'? 'new'? TypeParams? @(Params) '=>' Type
Union <- SOFT? ('|' / '&')? TypePost (SOFT? ('|' / '&') TypePost)*
TypePost <- ('keyof' / 'readonly' / 'unique' / 'infer' / 'typeof')* TypePrim (@[TypeIdx])*
TypeIdx <- Type?
TypePrim <- @(Type) / @{TypeMembers} / @[TupleItems] / '-'? NUM / STR / TypeTpl / 'this' / 'void' / 'null' / 'true' / 'false' / 'import' @(Args) ('.' name)* TypeArgs? / id ('.' name)* TypeArgs?
TypeTpl <- TEMPLATE (@"Type)*
TupleItems <- (TupleItem (',' TupleItem)* ','?)?
TupleItem <- '...'? (id '?'? ':' Type / Type '?'?)
TypeMembers <- (TypeMember (';' / ',' / SOFT)* )*
TypeMember <- ';' / SOFT / ('+' / '-')? ('readonly' !(':' / '?' / OPEN_PAREN))? (@[MapIn] (('+' / '-')? '?')? Ann? / 'new'? TypeParams? @(Params) Ret? / (('get' / 'set') !(':' / '?' / OPEN_PAREN / '<'))? PropName '?'? (TypeParams? @(Params) Ret? / Ann?)) TypeEnd
TypeEnd <- ';' / ',' / SOFT / END
MapIn <- id ':' Type / id 'in' Type ('as' Type)? / Expr
"""


def _js(ts: bool) -> str:
    words = {
        "TYPE_WORDS": "'abstract' 'accessor' 'any' 'asserts' 'boolean' 'declare' 'implements' 'infer' 'interface' 'is' 'keyof' 'module' 'namespace' 'never' 'number' 'object' 'override' 'private' 'protected' 'public' 'readonly' 'satisfies' 'string' 'symbol' 'type' 'undefined' 'unique' 'unknown'" if ts else "",
        "MOD_WORDS": "'public' 'private' 'protected' 'readonly' 'abstract' 'override' 'declare' 'accessor'" if ts else "",
        "PARAM_MODS": "(('public' / 'private' / 'protected' / 'readonly' / 'override') !(':' / '?' / ',' / '=' / END))*" if ts else "",
        "ABSTRACT": "'abstract'?" if ts else "",
        "OVERLOAD": "Stop" if ts else "NEVER",
        "TYPE_ONLY": "('type' !('from' / ','))?" if ts else "",
        "TYPE_NAME": "('type' !(',' / 'as' / END))?" if ts else "",
        "IMPORT_EQ": "id '=' Expr Stop" if ts else "NEVER",
        "EXPORT_AS": "'as' 'namespace' id Stop" if ts else "NEVER",
        "TARGET_MARK": "'!'" if ts else "",
        "TYPE_ASSERT": "/ '<' Type '>' Unary" if ts else "",
        "CONST_INIT": "('=' Expr)?" if ts else "'=' Expr",
        "TYPE_OP": "('as' / 'satisfies') ('const' / Type)" if ts else "NEVER",
        "NONNULL": "'!'" if ts else "NEVER",
        "OPEN_PAREN": "PAREN",
    }
    text = _JS
    for k, v in words.items():
        text = text.replace(k, v)
    extra = (_TS_ONLY if ts else _JS_ONLY).replace("OPEN_PAREN", "PAREN")
    return text + extra + "\n%PAREN = '('\nNEVER <- !. !END\n"


_RUST_EXPR = r"""
Expr# <- 'return' Expr#? / 'break' LIFE? Expr#? / 'continue' LIFE? / Closure# / Range# (AssignOp Expr#)?
Range# <- ('..' / '..=') Or#? / Or# (('..' / '..=') Or#?)?
Or# <- Cmp# (('&&' / '||') Cmp#)*
Cmp# <- Bin# (CmpOp Bin# !CmpOp)?
Bin# <- Unary# (ArithOp Unary# / 'as' TypeNB)*
Unary# <- ('-' / '!' / '*' / '&&' 'mut'? / '&' ('raw' ('const' / 'mut'))? 'mut'?)* (Closure# / Postfix#)
Postfix# <- Primary# Trailer*
Closure# <- 'static'? 'async'? 'move'? ('||' / '|' ClosureParams? '|') ('->' TypeNB Block / Expr#)
Primary# <- 'let' Pat '=' LetRhs / Literal / BlockLike / Macro / PathExpr STRUCT / @(Tuple) / @[Array] / 'return' Expr#? / 'break' LIFE? Expr#? / 'continue' LIFE?
"""
RUST = (
    r"""
File <- InnerAttr* Item*
%id = IDENT 'union' 'raw' 'macro_rules'
%seg = IDENT 'union' 'raw' 'self' 'Self' 'super' 'crate'
%binop = '+' '-' '*' '/' '%' '^' '|' '&' '&&' '||' '==' '!=' '<' '<=' '<<'
%arith = '+' '-' '*' '/' '%' '^' '|' '&' '<<'
%compare = '==' '!=' '<' '<='
%assign = '=' '+=' '-=' '*=' '/=' '%=' '^=' '&=' '|=' '<<='
InnerAttr <- '#' '!' @[Meta]
Attr <- '#' @[Meta]
Meta <- Tok*
Tok <- @(Meta) / @[Meta] / @{Meta} / !OPEN .
Vis <- 'pub' @(Meta)? / 'crate' !'::'
Item <- Attr* (Macro1 / Vis? ItemKind)
Macro1 <- 'macro_rules' '!' id (@{Meta} / @(Meta) ';' / @[Meta] ';') / Path '!' (@{Meta} / @(Meta) ';' / @[Meta] ';')
ItemKind <- Fn / 'struct' id Generics? (Where? @{Fields} / @(TupleFields) Where? ';' / ';') / 'union' id Generics? Where? @{Fields} / 'enum' id Generics? Where? @{Variants}
  / 'unsafe'? 'trait' id Generics? (':' Bounds?)? Where? @{AssocItems} / 'unsafe'? 'impl' Generics? 'const'? '!'? Type ('for' Type)? Where? @{AssocItems} / 'unsafe'? 'mod' id (';' / @{File}) / 'use' UseTree ';'
  / 'const' (id / IDENT) ':' Type ('=' Expr)? ';' / 'static' 'mut'? id ':' Type ('=' Expr)? ';' / 'type' id Generics? (':' Bounds)? Where? ('=' Type)? Where? ';'
  / 'extern' 'crate' seg ('as' id)? ';' / 'unsafe'? 'extern' STR? @{File}
Fn <- ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' id Generics? @(FnParams) ('->' Type)? Where? (Block / ';')
FnParams <- (FnParam (',' FnParam)* ','?)?
FnParam <- Attr* ('&' LIFE? 'mut'? 'self' / 'mut'? 'self' (':' Type)? / '...' / Pat ':' (Type / '...'))
Fields <- (Field (',' Field)* ','?)?
Field <- Attr* Vis? id ':' Type
TupleFields <- (Attr* Vis? Type (',' Attr* Vis? Type)* ','?)?
Variants <- (Variant (',' Variant)* ','?)?
Variant <- Attr* Vis? id (@{Fields} / @(TupleFields))? ('=' Expr)?
AssocItems <- InnerAttr* (Attr* (Macro1 / Vis? IDENT? ItemKind))*
UseTree <- '::'? (seg ('::' seg)* ('::' ('*' / @{UseTrees}) / 'as' id)? / '*' / @{UseTrees})
UseTrees <- (UseTree (',' UseTree)* ','?)?
Generics <- '<' (GenParam (',' GenParam)* ','?)? '>'
GenParam <- Attr* (LIFE (':' LIFE ('+' LIFE)*)? / 'const' id ':' Type ('=' (@{Stmts} / '-'? Literal / id))? / id (':' Bounds?)? ('=' Type)?)
Where <- 'where' (WherePred (',' WherePred)* ','?)?
WherePred <- LIFE ':' LIFE ('+' LIFE)* / ForLife? Type ':' Bounds?
ForLife <- 'for' Generics
Bounds <- Bound ('+' Bound)* '+'?
Bound <- LIFE / @(Bound) / '?'? ForLife? ('~' 'const')? TypePath / 'use' GenArgs
Type <- TypeNB ('+' Bound)*
TypeNB <- ('&' / '&&') LIFE? 'mut'? TypeNB / '*' ('const' / 'mut') TypeNB / @(Types) / @[ArrayType] / '!' / ForLife? ('unsafe' / 'extern' STR?)* 'fn' @(FnTypes) ('->' TypeNB)? / ('impl' / 'dyn') Bounds / ForLife TypePath / TypePath ('!' OPEN1)?
OPEN1 <- @(Meta) / @[Meta] / @{Meta}
FnTypes <- ((id ':')? (Type / '...') (',' (id ':')? (Type / '...'))* ','?)?
Types <- (Type (',' Type)* ','?)?
ArrayType <- Type (';' Expr)?
TypePath <- ('<' Type ('as' TypePath)? '>' '::' / '::')? TypeSeg ('::' TypeSeg)*
TypeSeg <- seg ('::'? GenArgs / @(Types) ('->' TypeNB)?)?
GenArgs <- '<' (GenArg (',' GenArg)* ','?)? '>'
GenArg <- LIFE / id GenArgs? ('=' / ':') (Bounds / Type) / Type / '-'? Literal / @{Stmts}
Path <- '::'? seg ('::' seg)*
PathExpr <- ('<' Type ('as' TypePath)? '>' '::' / '::')? seg ('::' (GenArgs / seg))*
Literal <- NUM / STR / CHAR / 'true' / 'false'
Block <- @{Stmts}
Stmts <- InnerAttr* BStmt* (Attr* Expr)?
BStmt <- ';' / Attr* ('let' Pat (':' Type)? ('=' Expr ('else' Block)?)? ';' / !ExprStart Item / BlockLike !('.' / '?') / MacroBlock !('.' / '?') / Expr ';')
ExprStart <- ('unsafe' / 'const' / 'async') ('move'? OPENB) / 'async' 'move'? '|' / 'static' ('move' / '|')
OPENB <- @{Meta}
MacroBlock <- Path '!' @{Meta}
Macro <- Path '!' OPEN1
BlockLike <- LIFE ':' (Loop / Block) / Loop / 'if' ExprN Block ('else' (BlockElse / Block))? / 'match' ExprN @{Arms} / ('unsafe' / 'const' / 'async' 'move'?)? Block
BlockElse <- 'if' ExprN Block ('else' (BlockElse / Block))?
Loop <- 'loop' Block / 'while' ExprN Block / 'for' Pat 'in' ExprN Block
Arms <- InnerAttr* (Arm)*
Arm <- Attr* Pat ('if' Expr)? '=>' (BlockLike (',' / !('.' / '?' / binop / '=')) / Expr (',' / END))
AssignOp <- assign / '>' '>' '='
BinOp <- binop / '>' '>'? '='?
ArithOp <- arith / '>' '>' !'='
CmpOp <- compare / '>' !'>' '='?
LetRhs <- UnaryN (BinLet UnaryN)*
BinLet <- !'&&' BinOp
Trailer <- '.' ('await' / NUM / seg ('::' GenArgs)?) / @(Args) / @[Expr] / '?'
Args <- (Attr* Expr (',' Attr* Expr)* ','?)?
Tuple <- InnerAttr* (Attr* Expr (',' Attr* Expr)* ','?)?
Array <- (Attr* Expr (';' Expr / (',' Attr* Expr)* ','?))?
StructLit <- @{StructItems}
StructItems <- (StructItem (',' StructItem)* (',' ('..' Expr?)?)? / '..' Expr?)?
StructItem <- Attr* ((id / NUM) ':' Expr / id)
ClosureParams <- ClosureParam (',' ClosureParam)* ','?
ClosureParam <- Pat1 (':' Type)?
Pat <- '|'? Pat1 ('|' Pat1)*
Pat1 <- PatRange / ('&' / '&&') 'mut'? Pat1 / @(Pats) / @[Pats] / 'ref'? 'mut'? id !('::' / OPENX / '!') ('@' Pat1)? / Macro / PathExpr (@(Pats) / @{FieldPats})? / '..' / 'const' Block
OPENX <- @(Meta) / @{Meta}
PatRange <- PatLit (('..=' / '...' / '..') PatLit?)? / ('..=' / '..') PatLit
PatLit <- '-'? Literal / PathExpr &('..=' / '...' / '..')
Pats <- (Attr* Pat (',' Attr* Pat)* ','?)?
FieldPats <- (FieldPat (',' FieldPat)* ','?)?
FieldPat <- Attr* ('..' / (id / NUM) ':' Pat / 'ref'? 'mut'? id)
"""
    + _RUST_EXPR.replace("#", "").replace("STRUCT", "StructLit?")
    + _RUST_EXPR.replace("#", "N").replace(" STRUCT", "")
)

_GO_EXPR = r"""
Exprs# <- Expr# (',' Expr#)*
Expr# <- Unary# (binop Unary#)*
Unary# <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-')* Primary#
Primary# <- Operand# ('.' (id / @(TypeArg)) / @[Index] / @(Args) ELEMS)*
Operand# <- 'func' Sig Block / NUM / STR+ / CHAR / id / @(ExprOrType) / TypeLit LITELEMS
Simple# <- id (',' id)* ':=' ('range' Expr# / Exprs#) / Expr# (opassign Expr# / '++' / '--' / '<-' Expr# / (',' Expr#)* '=' ('range' Expr# / Exprs#))?
"""
GO = (
    r"""
File <- 'package' id ';' ('import' (ImportSpec / @(ImportSpecs)) ';')* (TopDecl ';')*
%id = IDENT
%binop = '||' '&&' '==' '!=' '<' '<=' '>' '>=' '+' '-' '|' '^' '*' '/' '%' '<<' '>>' '&' '&^'
%opassign = '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>=' '&^='
%callee = IDENT ')' ']' '}'
ImportSpec <- ('.' / id)? STR
ImportSpecs <- (ImportSpec (';' / END))*
TopDecl <- 'func' @(Params)? id @[TypeParams]? Sig Block? / Decl
Decl <- 'var' (VarSpec / @(VarSpecs)) / 'const' (ConstSpec / @(ConstSpecs)) / 'type' (TypeSpec / @(TypeSpecs))
VarSpec <- id (',' id)* (Type ('=' Exprs)? / '=' Exprs)
ConstSpec <- id (',' id)* Type? '=' Exprs
ConstSpecs <- (ConstSpec (';' / END) ((ConstSpec / id (',' id)*) (';' / END))*)?
VarSpecs <- (VarSpec (';' / END))*
TypeSpec <- id '=' Type / id @[TypeParams] Type / id Type
TypeSpecs <- (TypeSpec (';' / END))*
TypeParams <- id (',' id)* Constraint (',' id (',' id)* Constraint)* ','?
Constraint <- '~'? Type ('|' '~'? Type)*
Sig <- @(Params) (@(Params) / Type)?
Params <- (Named (',' Named)* (',' id '...' Type)? ','? &END / id '...' Type ','? &END / Type (',' Type)* (',' '...' Type)? ','? / '...' Type ','?)?
Named <- id (',' id)* Type
Type <- id ('.' id)? @[TypeList]? / TypeLit / @(Type)
TypeList <- Type (',' Type)* ','?
TypeLit <- '*' Type / @[ArrayLen] Type / 'map' @[TypeArg] Type / 'chan' '<-'? Type / '<-' 'chan' Type / 'func' Sig / 'struct' @{Fields} / 'interface' @{IElems}
TypeArg <- 'type' / Type
ArrayLen <- ('...' / Expr)?
Fields <- (Field (';' / END))*
Field <- (id (',' id)* Type / '*'? id ('.' id)? @[TypeList]?) STR?
IElems <- (IElem (';' / END))*
IElem <- id Sig / Constraint
Block <- @{Stmts}
Stmts <- (';' / Stmt (';' / END))*
Stmt <- Decl / 'if' If / 'for' For / 'switch' Switch / 'select' @{Comms} / 'return' Exprs? / ('break' / 'continue') id? / 'goto' id / 'fallthrough' / ('go' / 'defer') Expr CALLED / Block / id ':' Stmt? / Simple
If <- (SimpleN? ';')? ExprN Block ('else' ('if' If / Block))?
For <- Block / ('range' ExprN / (ExprsN (':=' / '='))? 'range' ExprN) Block / ForClause Block / ExprN Block
ForClause <- SimpleN? ';' ExprN? ';' SimpleN?
Switch <- (SimpleN? ';')? SimpleN? @{Cases}
Cases <- (('case' ExprsT / 'default') ':' CaseStmts)*
ExprsT <- (Expr / Type) (',' (Expr / Type))*
CaseStmts <- (';' / !('case' / 'default') Stmt (';' / END))*
Comms <- (('case' Simple / 'default') ':' CaseStmts)*
Index <- (Expr / Type)? ':' Expr? (':' Expr)? / ExprsT ','?
Args <- ((Expr / Type) '...'? (',' (Expr / Type) '...'?)* ','?)?
ExprOrType <- Expr / Type
Elems <- (Elem (',' Elem)* ','?)?
Elem <- ElemPart (':' ElemPart)?
ElemPart <- @{Elems} / Expr
"""
    + _GO_EXPR.replace("#", "").replace("LITELEMS", "@{Elems}?").replace("ELEMS", "/ @{Elems}")
    + _GO_EXPR.replace("#", "N").replace("LITELEMS", "(!ENDHEAD @{Elems})?").replace(" ELEMS", "")
    + "ENDHEAD <- @{Stmts} (END / ';')\n"
)

SWIFT = r"""
File <- Stmts
Stmts <- (';' / SOFT / Stmt (SOFT / ';' / END / &'case' / &'default' / AfterBlock))*
AfterBlock <- NEVER
NEVER <- !. !END
%id = IDENT 'actor' 'async' 'convenience' 'didSet' 'dynamic' 'final' 'get' 'indirect' 'infix' 'lazy' 'mutating' 'nonmutating' 'optional' 'override' 'postfix' 'prefix' 'required' 'set' 'some' 'any' 'unowned' 'weak' 'willSet' 'consuming' 'borrowing' 'nonisolated' 'isolated' 'package' 'each' 'macro' 'self' 'Self' 'super' 'open' '_'
%name = IDENT WORDS
%mod = 'public' 'private' 'fileprivate' 'internal' 'open' 'package' 'static' 'final' 'lazy' 'weak' 'unowned' 'override' 'mutating' 'nonmutating' 'required' 'convenience' 'dynamic' 'optional' 'indirect' 'prefix' 'postfix' 'infix' 'nonisolated' 'isolated' 'consuming' 'borrowing'
%op = '==' '!=' '===' '!==' '<' '<=' '>=' '<<' '+' '-' '*' '/' '%' '&' '|' '^' '&&' '||' '??' '...' '..<' '&+' '&-' '&*' '=' '+=' '-=' '*=' '/=' '%=' '&&=' '||=' '<<=' '>>=' '~'
%pre = '-' '+' '!' '~' '&' '...' '..<'
%BRACE = '{'
Attr <- '@' name ('.' name)* @(Balanced)? SOFT?
Balanced <- Tok*
Tok <- @(Balanced) / @[Balanced] / @{Balanced} / @"Balanced / !OPEN .
Mod <- 'class' &('func' / 'var' / 'let' / 'subscript' / 'override' / 'final' / 'public' / 'private' / 'internal') / mod @(Balanced)? !('.' / ':' / '=' / ')')
Stmt <- Directive / Mod* Attr (Attr / Mod SOFT?)* (ProtoDecl !(SOFT? '{') / Decl) / (Mod SOFT?)* Decl / 'if' Conds SOFT? Block (SOFT? 'else' SOFT? (Block / ElseIf))? / 'guard' Conds SOFT? 'else' SOFT? Block / 'while' Conds SOFT? Block / 'repeat' SOFT? Block SOFT? 'while' Expr
  / 'for' 'try'? 'await'? 'case'? Pattern (':' Type)? 'in' ExprN ('where' ExprN)? SOFT? Block / 'switch' ExprN SOFT? @{Cases} / 'do' ThrowsT? SOFT? Block (SOFT? 'catch' (!BRACE CatchHead)? SOFT? Block)* / 'defer' Block
  / 'return' Expr? / 'throw' Expr / ('break' / 'continue') IDENT? / 'fallthrough' / id ':' SOFT? Stmt / Expr
ElseIf <- 'if' Conds SOFT? Block (SOFT? 'else' SOFT? (Block / ElseIf))?
ThrowsT <- 'throws' @(Type)?
CatchHead <- CatchItem (',' CatchItem)*
CatchItem <- Pattern ('where' ExprN)?
Block <- @{Stmts}
Directive <- '#' ('if' / 'else' / IDENT) DirTok*
DirTok <- !SOFT Tok
Conds <- Cond (',' SOFT? Cond)*
Cond <- 'case' Pattern (':' Type)? '=' ExprN / ('let' / 'var') Pattern (':' Type)? ('=' ExprN)? / '#' IDENT @(Balanced) / ExprN
Decl <- 'import' ('struct' / 'class' / 'enum' / 'protocol' / 'func' / 'var' / 'let' / 'typealias')? name ('.' name)* / ('let' / 'var') Binding (',' Binding)* / 'func' (name / op / '<' / '>' / '!')+ Generics? @(Params) Effects ('->' Type)? Where? SOFT? Block
  / ('struct' / 'class' / 'actor') name Generics? Inherit? Where? SOFT? Block / 'enum' name Generics? Inherit? Where? SOFT? @{EnumBody} / 'protocol' name Generics? Inherit? Where? SOFT? @{ProtoBody} / 'extension' Type Inherit? Where? SOFT? Block
  / 'init' ('?' / '!')? Generics? @(Params) Effects Where? SOFT? Block / 'deinit' SOFT? Block / 'subscript' Generics? @(Params) '->' Type Where? SOFT? @{PropBody} / 'typealias' name Generics? '=' Type Where? / 'associatedtype' name Inherit? ('=' Type)? Where?
  / ('operator' (op / '<' / '>' / '!' / '.')+ (':' name)?) / 'precedencegroup' name @{Balanced} / 'case' EnumCase (',' EnumCase)* / 'macro' name Generics? @(Params) ('->' Type)? ('=' Expr)?
EnumBody <- Stmts
ProtoBody <- (';' / SOFT / Directive / (Attr / Mod SOFT?)* ProtoDecl (SOFT / ';' / END))*
ProtoDecl <- 'func' (name / op / '<' / '>' / '!')+ Generics? @(Params) Effects ('->' Type)? Where? / 'init' ('?' / '!')? Generics? @(Params) Effects Where? / Decl
EnumCase <- name @(EnumParams)? ('=' Expr)?
EnumParams <- (EnumParam (',' EnumParam)* ','?)?
EnumParam <- (name name? ':')? Type ('=' Expr)?
Inherit <- ':' Type (',' Type)*
Generics <- '<' GenParam (',' GenParam)* '>'
GenParam <- 'each'? name (':' Type)?
Where <- SOFT? 'where' Req (',' Req)*
Req <- Type ('==' / ':') Type
Effects <- ('async' / 'throws' @(Type)? / 'rethrows')*
Params <- (Param (',' Param)* ','?)?
Param <- Attr* name name? ':' Attr* ('inout' / 'borrowing' / 'consuming')? Type '...'? ('=' Expr)?
Binding <- Pattern (':' Type)? ('=' SOFT? Expr)? (SOFT? @{PropBody})?
PropBody <- PropAcc+ SOFT? / Stmts
PropAcc <- SOFT? (Attr / Mod)* ('get' / 'set' / 'willSet' / 'didSet' / IDENT) @(Balanced)? Effects (SOFT? Block)? &(SOFT / END / 'get' / 'set' / 'willSet' / 'didSet' / mod / '@')
Pattern <- ('let' / 'var') Pattern / 'is' Type / Pattern1 ('as' Type)?
Pattern1 <- @(PatternList) '?'? / '.' name @(PatternList)? '?'? / id !('.' / '(') '?'? / ExprN
PatternList <- (PatternItem (',' PatternItem)* ','?)?
PatternItem <- (name ':')? Pattern
Type <- Attr* ('inout' / 'some' / 'any' / 'each' / 'repeat' / 'borrowing' / 'consuming')? TypePost ('&' TypePost)* (Effects '->' Type)?
TypePost <- TypePrim ('?' / '!' / '.' name TypeArgs?)*
TypePrim <- @(TupleType) / @[ArrayType] / id TypeArgs? / '~' TypePrim
TupleType <- (TupleItem (',' TupleItem)* ','?)?
TupleItem <- (name name? ':')? Attr* 'inout'? Type '...'? ('=' Expr)?
ArrayType <- Type (':' Type)?
TypeArgs! <- '<' Type (',' Type)* '>'
Expr! <- ExprX
ExprX <- Bin
Bin <- Unary (BinRest)*
BinRest <- (op / '>' '>'? '='?) SOFT? Unary / '?' SOFT? Expr SOFT? ':' SOFT? Expr / 'is' Type / 'as' ('?' / '!')? Type / '...'
Unary <- ('try' ('?' / '!')? / 'await' / pre)* Postfix
Postfix <- Primary (Trailer / @{Closure} (name ':' @{Closure})*)*
Trailer <- SOFT? '.' (name TypeArgs? / NUM / @(Args)) / '?' &('.' / '(' / '[' / Q) / '!' / @(Args) / @[Args] / TypeArgs &'(' / '...' &END
Q <- '!'
Primary <- NUM / Str / 'true' / 'false' / 'nil' / 'if' Conds SOFT? Block SOFT? 'else' SOFT? (Block / ElseIf) / 'switch' ExprN SOFT? @{Cases} / id / @(Args) / @[ArrayIn] / @{Closure} / '.' name / '#' name @(Args)? / '\' . / '$' NUM / op
Str <- STR (@"Args)*
Args <- (Arg (',' Arg)* ','?)?
Arg <- (name ':')? (Expr / op / '<' / '>')
ArrayIn <- (':' / ArrItem (',' SOFT? ArrItem)* ','?)?
ArrItem <- Expr (':' Expr)?
Closure <- ClosureHead? Stmts
ClosureHead <- SOFT? Attr* (@[Balanced])? (@(ClosureParams) / id (',' id)*)? Effects ('->' Type)? 'in' SOFT?
ClosureParams <- (ClosureParam (',' ClosureParam)* ','?)?
ClosureParam <- name name? (':' Attr* 'inout'? Type '...'?)?
ExprN! <- UnaryN (BinRestN)*
BinRestN <- (op / '>' '>'? '='?) SOFT? UnaryN / '?' SOFT? ExprN SOFT? ':' SOFT? ExprN / 'is' Type / 'as' ('?' / '!')? Type
UnaryN <- ('try' ('?' / '!')? / 'await' / pre)* PostfixN
PostfixN <- Primary (Trailer / @{Closure} &('.' / '?'))*
Cases <- SOFT? (Directive SOFT? / Attr? ('case' CaseItem (',' SOFT? CaseItem)* / 'default') ':' CaseStmts)*
CaseItem <- Pattern ('where' ExprN)?
CaseStmts <- (';' / SOFT / !('case' / 'default' / '@' IDENT 'default') Stmt (SOFT / ';' / END / &'case' / &'default'))*
"""

CSHARP = r"""
File <- ('extern' 'alias' id ';')* Using* Top*
%id = IDENT 'add' 'alias' 'and' 'ascending' 'async' 'await' 'by' 'descending' 'dynamic' 'equals' 'file' 'from' 'get' 'global' 'group' 'init' 'into' 'join' 'let' 'managed' 'nameof' 'not' 'notnull' 'on' 'or' 'orderby' 'partial' 'record' 'remove' 'required' 'scoped' 'select' 'set' 'unmanaged' 'value' 'var' 'when' 'where' 'with' 'yield'
%prim = 'bool' 'byte' 'char' 'decimal' 'double' 'float' 'int' 'long' 'object' 'sbyte' 'short' 'string' 'uint' 'ulong' 'ushort' 'void'
%binop = '==' '!=' '<' '<=' '<<' '+' '-' '*' '/' '%' '&' '|' '^' '&&' '||' '??'
%assign = '=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '??='
%modword = 'public' 'private' 'protected' 'internal' 'static' 'readonly' 'sealed' 'abstract' 'virtual' 'override' 'new' 'extern' 'unsafe' 'volatile' 'async' 'partial' 'const' 'required' 'file' 'fixed' 'ref'
Using <- 'global'? 'using' ('static' / 'unsafe')? (id '=')? Type ';'
Top <- 'namespace' QName (';' Using* / @{NsBody} ';'?) / AttrList* Mod* TypeDecl / AttrList / Stmt
NsBody <- Using* ('namespace' QName @{NsBody} ';'? / AttrList* Mod* TypeDecl)*
QName <- id (('.' / '::') id)*
AttrList <- @[Attrs]
Attrs <- (id ':' / 'return' ':' / 'event' ':')? Attr1 (',' Attr1)* ','?
Attr1 <- QName TypeArgs? @(Args)?
Mod <- modword !('=' / ';' / ',' / ')' / '.')
TypeDecl <- ('class' / 'struct' / 'interface' / 'record' ('class' / 'struct')?) id TypeParams? @(Params)? Bases? Constraint* (@{Members} ';'? / ';') / 'enum' id (':' Type)? @{EnumItems} ';'? / 'delegate' Type id TypeParams? @(Params) Constraint* ';'
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- AttrList* ('in' / 'out')? id
Bases <- ':' Base (',' Base)*
Base <- Type @(Args)?
Constraint <- 'where' id ':' Con (',' Con)*
Con <- 'new' @(Args) / ('class' / 'struct') '?'? / 'default' / Type
EnumItems <- (AttrList* id ('=' Expr)? (',' AttrList* id ('=' Expr)?)* ','?)?
Members <- (';' / AttrList* Member)*
Member <- Mod* (TypeDecl / 'event' Type (Declr (',' Declr)* ';' / QName @{Accessors}) / 'implicit' 'operator' OpRest / 'explicit' 'operator' OpRest / '~' id @(Params) Body / id @(Params) (':' ('base' / 'this') @(Args))? Body / Type MemberRest)
OpRest <- 'checked'? Type @(Params) Body
MemberRest <- 'operator' 'checked'? OpTok @(Params) Body / (ExplicitIf? 'this') @[Params] (@{Accessors} / '=>' Expr ';') / ExplicitIf? id TypeParams? @(Params) Constraint* Body / ExplicitIf? id @{Accessors} ('=' Expr ';')? / ExplicitIf? id '=>' Expr ';' / Declr (',' Declr)* ';'
ExplicitIf <- (id TypeArgs? ('.' / '::'))+ &(id / 'this')
OpTok <- binop / '>' '>'? '>'? '='? / '!' / '~' / '++' / '--' / 'true' / 'false'
Declr <- id @[Expr]? ('=' VarInit)?
VarInit <- @{ArrayInit} / 'ref' Expr / Expr
ArrayInit <- (VarInit (',' VarInit)* ','?)?
Accessors <- (AttrList* Mod* ('get' / 'set' / 'init' / 'add' / 'remove') Body)+
Body <- Block / '=>' Expr ';' / ';'
Params <- (Param (',' Param)*)?
Param <- AttrList* ('this' / 'ref' / 'out' / 'in' / 'params' / 'scoped' !('=' / ',') / 'readonly')* Type id ('=' Expr)?
Type <- TypeNN TypeSuffix*
TypeNN <- 'ref' 'readonly'? TypeNN / prim / @(TupleType) / 'delegate' '*' id? TypeArgs / TypeName
TypeName <- id TypeArgs? (('.' / '::') id TypeArgs?)*
TypeSuffix <- '?' / '*' / @[Ranks]
Ranks <- ','*
TupleType <- Type id? (',' Type id?)+
TypeArgs! <- '<' (','* &'>' / AttrList* Type (',' Type)*) '>'
Block <- @{Stmts}
Stmts <- Stmt*
Stmt <- ';' / Block / 'if' @(Expr) Stmt ('else' Stmt)? / 'while' @(Expr) Stmt / 'do' Stmt 'while' @(Expr) ';' / 'for' @(ForHead) Stmt / 'await'? 'foreach' @(EachHead) Stmt / 'switch' @(Args) @{Sections} / 'return' ('ref'? Expr)? ';' / 'break' ';' / 'continue' ';'
  / 'throw' Expr? ';' / 'goto' ('case' Expr / 'default' / id) ';' / 'try' Block (Catch* 'finally' Block / Catch+) / 'lock' @(Expr) Stmt / 'await'? 'using' (@(UsingHead) Stmt / LocalVar ';') / 'fixed' @(LocalVarIn) Stmt / ('checked' / 'unchecked' / 'unsafe') Block
  / 'yield' ('return' Expr / 'break') ';' / 'const' LocalVar ';' / LocalFunc / LocalVar ';' / id ':' Stmt / Expr ';'
LocalFunc <- AttrList* ('static' / 'async' / 'unsafe' / 'extern')* Type id TypeParams? @(Params) Constraint* Body
LocalVar <- 'scoped'? Type Declr (',' Declr)*
LocalVarIn <- LocalVar
ForHead <- (LocalVar / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)?
EachHead <- (Type id / 'var' @(Desig) / Expr) 'in' Expr
Desig <- (id / @(Desig)) (',' (id / @(Desig)))*
UsingHead <- LocalVar / Expr
Catch <- 'catch' @(CatchIn)? ('when' @(Expr))? Block
CatchIn <- Type id?
Sections <- (('case' Pattern ('when' Expr)? / 'default') ':' (!('case' / 'default' ':') Stmt)*)*
Expr! <- Lambda / 'throw' Expr / 'ref' Expr / Query / Cond (AssignOp Expr)?
AssignOp <- assign / '>' '>' '>'? '='
Lambda <- AttrList* ('static' / 'async')* (id / @(LambdaParams) &'=>' / Type @(LambdaParams)) '=>' (Block / Expr)
LambdaParams <- (LParam (',' LParam)*)?
LParam <- AttrList* ('ref' / 'out' / 'in' / 'params' / 'scoped')* (Type id ('=' Expr)? / id)
Query <- 'from' (Type !'in')? id 'in' Expr QClause+
QClause <- 'from' (Type !'in')? id 'in' Expr / 'where' Expr / 'let' id '=' Expr / 'join' (Type !'in')? id 'in' Expr 'on' Expr 'equals' Expr ('into' id)? / 'orderby' Expr ('ascending' / 'descending')? (',' Expr ('ascending' / 'descending')?)* / 'select' Expr / 'group' Expr 'by' Expr / 'into' id
Cond <- Bin ('?' Expr ':' Expr)?
Bin <- Unary (BinOp (Lambda / 'throw' Expr / Unary) / 'is' Pattern / 'as' TypeAs / 'switch' @{Arms} / 'with' @{ArrayInit} / '..' Unary?)*
TypeAs <- TypeNN (@[Ranks])* ('?' !(Unary ':'))?
BinOp <- binop / '>' '>'? '>'? '='?
Unary <- ('+' / '-' / '!' / '~' / '++' / '--' / '&' / '*' / '^' / 'await' &UnaryStart)* (Cast / Postfix) / '..' Unary?
UnaryStart <- id / '(' / 'new' / 'this' / STR / 'base'
Cast <- @(CastType) &CastNext Unary
CastType <- Type
CastNext <- id / prim / NUM / STR / CHAR / 'this' / 'base' / 'new' / 'true' / 'false' / 'null' / 'typeof' / 'default' / 'sizeof' / '(' / '!' / '~' / 'checked' / 'unchecked' / 'stackalloc'
Postfix <- Primary Trailer*
Trailer <- ('.' / '?.' / '->' / '::') id (TypeArgs &TypeArgEnd)? / '?' @[Args] / @[Args] / @(Args) / '++' / '--' / '!' !'='
TypeArgEnd <- '(' / ')' / '.' / ',' / ';' / ']' / '}' / ':' / '?' / '==' / '!=' / END
Primary <- NUM / STR (@"Hole)* / CHAR / 'true' / 'false' / 'null' / 'this' / 'base' / 'new' New / ('typeof' / 'sizeof' / 'checked' / 'unchecked') @(TypeOrExpr) / 'default' @(TypeOrExpr)? / 'stackalloc' Type? @[Args]? @{ArrayInit}? / 'delegate' @(Params)? Block / prim / id (TypeArgs &TypeArgEnd)? / @(Args) / @[Collection]
TypeOrExpr <- Type / Expr
Hole <- Expr (',' Expr)?
New <- @{ArrayInit} / @[Ranks] @{ArrayInit} / @(Args) @{ObjInit}? / TypeNN '?'? (@(Args) @{ObjInit}? / @[Ranks] TypeSuffix* @{ArrayInit} / @[Args] TypeSuffix* @{ArrayInit}? / @{ObjInit})
ObjInit <- (ObjItem (',' ObjItem)* ','?)?
ObjItem <- (id / @[Args]) '=' VarInit / @{ArrayInit} / Expr
Collection <- (ColItem (',' ColItem)* ','?)?
ColItem <- '..' Expr / Expr
Args <- (Arg (',' Arg)*)?
Arg <- (id ':')? ('ref' Expr / 'in' Expr / 'out' (Type id !('.' / '(') / Expr) / TypeId / Expr)
TypeId <- Type id &(',' / END)
Pattern <- PatAnd ('or' PatAnd)*
PatAnd <- PatNot ('and' PatNot)*
PatNot <- 'not'* PatPrim
PatPrim <- ('<' '='? / '<=' / '>' '='?) Shift / 'var' (id / @(Desig)) / @[ListPat] / PropPat / Type !('.' / '(') (PropPat / !('and' / 'or' / 'when') id)? / Type? @(PatList) @{PropPats}? id? / '..' Pattern? / Shift
Shift <- Unary ((binopS) Unary)*
%binopS = '+' '-' '*' '/' '%' '&' '|' '^' '<<'
PropPat <- @{PropPats} id?
PropPats <- (SubPat (',' SubPat)* ','?)?
SubPat <- id ('.' id)* ':' Pattern
PatList <- ((id ':')? Pattern (',' (id ':')? Pattern)*)?
ListPat <- (Pattern (',' Pattern)* ','?)?
Arms <- (Arm (',' Arm)* ','?)?
Arm <- Pattern ('when' Expr)? '=>' Expr
"""

TEXTS = {"python": PYTHON, "javascript": _js(False), "typescript": _js(True), "rust": RUST, "go": GO, "swift": SWIFT, "csharp": CSHARP}


@lru_cache(maxsize=16)
def grammar(language: str) -> Grammar:
    return Grammar(TEXTS[language], scanner(language, True))
