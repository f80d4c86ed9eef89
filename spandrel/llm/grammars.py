"""Grammars of the languages source files come in, for :mod:`spandrel.llm.peg`.

They describe the languages' syntax, not one dialect of it; where a grammar takes a construct
more widely than the language does (operator precedence, what may be assigned to), it does so
knowingly. ``Fast`` rules are terminals for the simplest statements, a subset of what the full
rules take, tried first for speed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from functools import cache

from spandrel.llm.peg import Grammar

_C_SPACE = r"(?>(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*)"
_JSON_SPACE = r"[ \t\r\n]*"
_STR = r'"(?:[^"\\\n]|\\[\s\S])*"'
_CHR = r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|x[0-9a-fA-F]+|[0-7]{1,3}|.))'"
_ID = r"[^\W\d]\w*"


def _words(text: str) -> str:
    return "|".join(text.split())


def _expand(grammar: str, **names: str) -> str:
    for k, v in names.items():
        grammar = grammar.replace(f"%{k}%", v.replace("/", r"\/"))
    return grammar


def _fast(space: str, ident: str, *forms: str) -> str:
    """A run of simple statements as one terminal; A is an atom, S an expression of two at most."""
    atom = rf"(?:{ident}(?:\[\d+\])?|\d+|{_STR})"
    call = rf"{ident}\({ident}(?:, {ident})*\)"
    simple = rf"(?:{call}|{atom}(?: [-+*] {atom})?)"
    return "(?>(?:" + "|".join(f.replace("CALL", call).replace("SIMPLE", simple).replace("ID", ident) for f in forms) + f"){space})+"


# ---------------------------------------------------------------- JavaScript and TypeScript

_JS_RESERVED = _words("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum")
_JS_ID = rf"(?!(?:{_JS_RESERVED})(?![\w$]))[^\W\d$]?[$\w]*(?<=[\w$])(?<!^)"
_JS_IDENT = rf"(?!(?:{_JS_RESERVED})(?![\w$]))(?:[^\W\d]|\$)[\w$]*"
_JS = r"""
Start <- Stmt*
Stmt <- /%fast%/ | Block | Var End | Func | Class | If | For | 'while' '(' Expr ')' Stmt | Do | 'return' Expr? End | 'throw' Expr End
      | /(?:break|continue)\b/ Id? End | Switch | Try | Import | Export | ';' | 'debugger' End | Typed | Id ':' Stmt | !NotExpr Expr End
NotExpr <- /(?:function|class|let\s*\[)\b/ | '{'
End <- ';' | &~/\}/ | ~/(?<=\n\s*)/ | !~/[\s\S]/
Block <- '{' Stmt* '}'
Id <- /%id%/
Prop <- /#?[\w$]+/
Var <- 'const' Target Ann? '=' Assign (',' Target Ann? '=' Assign)* | /(?:var|let)\b/ Bind (',' Bind)*
Bind <- Target '!'? Ann? ('=' Assign)?
Target <- Id | Array | Object
Func <- 'async'? 'function' '*'? Id? TParams? Params Ret? (Block | Overload)
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- Deco* Mod* '...'? (ThisP | Target) Opt? Ann? ('=' Assign)?
Class <- Deco* Abstract? 'class' (!'extends' !'implements' Id)? TParams? ('extends' Postfix TArgs?)? Implements? '{' Member* '}'
Member <- ';' | 'static' Block | Deco* Mod* /(?:static|async|get|set)\b(?!\s*[(=;:?])/* '*'? Name (Opt? TParams? Params Ret? (Block | Overload) | Opt? Ann? ('=' Assign)? End)
Deco <- '@' Postfix
Name <- Prop | Str | Num | '[' Assign ']'
If <- 'if' '(' Expr ')' Stmt ('else' Stmt)?
For <- 'for' 'await'? '(' ((/(?:var|let|const)\b/ Target Ann? | Postfix) /(?:of|in)\b/ Expr | (Var | Expr)? ';' Expr? ';' Expr?) ')' Stmt
Do <- 'do' Stmt 'while' '(' Expr ')' ';'?
Switch <- 'switch' '(' Expr ')' '{' (('case' Expr | 'default') ':' Stmt*)* '}'
Try <- 'try' Block ('catch' ('(' Target Ann? ')')? Block)? ('finally' Block)?
Import <- 'import' !~/[(.]/ 'type'? (Str | Clause 'from' Str) /with\b/? Object? End
Clause <- '{' (Spec (',' Spec)* ','?)? '}' | '*' 'as' Id | Id (',' Clause)?
Spec <- 'type'? (Prop | Str) ('as' (Prop | Str))?
Export <- 'export' ('default' (Func | Class | Assign End) | '*' ('as' Prop)? 'from' Str End | 'type'? '{' (Spec (',' Spec)* ','?)? '}' ('from' Str)? End | Var End | Func | Class | Typed)
Expr <- Assign (',' Assign)*
Assign <- Arrow | 'yield' '*'? Assign? | Cond (/(?:\*\*|>>>|<<|>>|&&|\|\||\?\?|[-+*\/%&|^])?=(?![=>])/ Assign)?
Arrow <- 'async'? (Id | TParams? Params Ret?) '=>' (Block | Assign)
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- Unary (Op Unary | As)*
Op <- /(?:===|!==|==|!=|<=|>=|>>>|<<|>>|&&|\|\||\?\?|\*\*|[-+*%<>&|^]|\/(?![\/*]))(?!=)|(?:instanceof|in)\b/
Unary <- /(?:typeof|void|delete|await)\b|\+\+|--|[!~+-]/ Unary | Postfix
Postfix <- Primary Tail* /\+\+|--/?
Tail <- '.' Prop | '?.' (Prop | '[' Expr ']' | Args) | '[' Expr ']' | Args | Template | NonNull | TArgs &~/\(/ Args
Args <- '(' ('...'? Assign (',' '...'? Assign)* ','?)? ')'
Primary <- 'new' ('.' 'target' | Unary) | Func | Class | Num | Str | Template | Regex | '(' Expr ')' | Array | Object | /(?:this|super|null|true|false)\b(?!\$)/ | 'import' ('.' 'meta' | &~/\(/) | Id | /#[\w$]+/
Array <- '[' (','* '...'? Assign)? (','+ '...'? Assign)* ','* ']'
Object <- '{' (Pair (',' Pair)* ','?)? '}'
Pair <- '...' Assign | /(?:async|get|set)\b(?!\s*[(,:=}])/? '*'? Name TParams? Params Ret? Block | Name ':' Assign | Id ('=' Assign)?
Num <- /0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?![\w$])/
Str <- /"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'/
Template <- ~/`/ (~/(?:[^`\\$]|\\[\s\S]|\$(?!\{))+/ | ~/\$\{\s*/ Expr ~/\}/)* /`/
Regex <- /\/(?![*\/])(?:[^\\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+\/[a-z]*/
%types%
"""
_JS_TYPES = r"""
Ann <- !~/(?:)/
ThisP <- !~/(?:)/
Ret <- !~/(?:)/
Opt <- !~/(?:)/
Mod <- !~/(?:)/
TParams <- !~/(?:)/
TArgs <- !~/(?:)/
As <- !~/(?:)/
NonNull <- !~/(?:)/
Typed <- !~/(?:)/
Abstract <- !~/(?:)/
Implements <- !~/(?:)/
Overload <- !~/(?:)/
"""
_TS_TYPES = r"""
Ann <- ':' Type
ThisP <- /this\b(?=\s*:)/
Ret <- ':' (Id 'is' Type | 'asserts' Id ('is' Type)? | Type)
Opt <- /[?!]/
Mod <- /(?:public|private|protected|readonly|override|declare|abstract|static)\b(?!\s*[(=;:?,)])/
TParams <- '<' TParam (',' TParam)* ','? '>'
TParam <- 'const'? Id ('extends' Type)? ('=' Type)?
TArgs <- '<' Type (',' Type)* '>'
As <- /(?:as|satisfies)\b/ ('const' | Type)
NonNull <- /!(?!=)/
Abstract <- /(?:abstract|declare)\b/
Implements <- 'implements' Type (',' Type)*
Overload <- End
Typed <- 'declare'? ('interface' Id TParams? ('extends' Type (',' Type)*)? ObjType | 'type' Id TParams? '=' Type End | 'const'? 'enum' Id '{' (Name ('=' Assign)? (',' Name ('=' Assign)?)* ','?)? '}' | /(?:namespace|module)\b/ (Id ('.' Id)* | Str) Block | 'declare' Stmt)
Type <- FnType | /keyof\b|readonly\b|infer\b|unique\b/ Type | Union ('extends' Union '?' Type ':' Type)?
FnType <- 'new'? TParams? Params '=>' Type
Union <- /[|&]/? Suffixed (/[|&]/ Suffixed)*
Suffixed <- (ObjType | '[' (Elem (',' Elem)* ','?)? ']' | '(' Type ')' | 'typeof' Id ('.' Prop)* | Str | /-?\d[\w.]*/ | Template | /(?:void|null|this|true|false|undefined)\b/ | Id ('.' Prop)* TArgs?) ('[' Type? ']')*
Elem <- '...'? (Id '?'? ':')? Type '?'?
ObjType <- '{' (Field /[;,]/?)* '}'
Field <- Mod* 'readonly'? ('[' Id (':' Type | 'in' Type) ']' /[-+]?\??/ ':' Type | 'new'? TParams? Params Ret? | Name '?'? (TParams? Params Ret? | Ann)?)
"""


def _js(types: str, ann: str) -> Grammar:
    ident = _JS_IDENT
    fast = _fast(_C_SPACE, ident, rf"(?:const|let) ID{ann} = SIMPLE;", "CALL;", r"return SIMPLE;")
    return Grammar(_expand(_JS, fast=fast, id=ident).replace("%types%", types), _C_SPACE)


# ---------------------------------------------------------------- C, C++ and Java

_C_RESERVED = _words("break case char const continue default do double else enum extern float for goto if inline int long register return short signed sizeof static struct switch typedef union unsigned void volatile while")
_CPP_RESERVED = _C_RESERVED + "|" + _words("alignas alignof bool catch class constexpr const_cast decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept nullptr operator private protected public reinterpret_cast static_assert static_cast template this throw true try typeid typename using virtual")
_PP_SPACE = r"(?>(?:\s+|//(?:[^\n\\]|\\[\s\S])*|/\*(?:[^*]|\*(?!/))*\*/|(?<![^\n])#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|elifdef|else|endif|pragma|error|warning|line)\b(?:[^\n\\]|\\[\s\S])*)*)"
_CEXPR = r"""
Expr <- Assign (',' Assign)*
Assign <- Cond (/(?:<<|>>|[-+*\/%&|^])?=(?!=)/ (Assign | Init))?
Cond <- Binary ('?' Expr ':' Assign)?
Binary <- Unary (/(?:==|!=|<=>|<=|>=|<<|>>|&&|\|\||[-+*%<>&|^]|\/(?![\/*]))(?!=)/ Unary)*
"""
_C = r"""
Start <- Top*
Top <- ';' | Fast | CppTop | Function | Decl ';' | /(?:_Static_assert|static_assert)\b/ '(' Expr ')' ';' | 'asm' '(' Str ')' ';'
Fast <- !~/(?:)/
Function <- Attr* Spec Declarator CtorInit? Block
Decl <- 'typedef'? Attr* Spec (Item (',' Item)*)?
Item <- Declarator (':' Cond)? ('=' (Init | Assign) | Init | Args)?
Spec <- Qual* Builtin (Qual | Builtin)* | Qual* Tag Qual* | Qual* TypeId Qual* &Follows | Qual+
Follows <- Declarator | ~/[;,)>]/ 
Qual <- /(?:%qual%)\b/
Builtin <- /(?:%builtin%)\b/
TypeId <- Path
Tag <- 'enum' /(?:class|struct)\b/? Id? (':' Spec)? ('{' (Id ('=' Cond)? (',' Id ('=' Cond)?)* ','?)? '}')? | /%tags%/ Attr* Id? Bases? ('{' Member* '}')?
Member <- Access | CppMember | Decl ';' | ';'
Declarator <- Ptr* (DName | '(' Declarator ')') Suffix* | Ptr+ Suffix* 
Ptr <- /[*]|%refs%/ Qual*
DName <- OpName | Path
Suffix <- '[' Expr? ']' | '(' Params? ')' Trail*
Params <- ('void' &~/\)/) | Param (',' Param)* (',' '...')? | '...'
Param <- Attr* Spec (Declarator | Abstract)? ('=' Assign)?
Abstract <- Ptr* ('(' Ptr+ ')')? ('[' Expr? ']' | '(' Params? ')')*
Attr <- '[[' ~/[^\]]*/ ']]' | '__attribute__' '((' ~/(?:[^()]|\([^()]*\))*/ '))'
Init <- '{' (Elem (',' Elem)* ','?)? '}'
Elem <- (('.' Id | '[' Cond ']')+ '=')? (Init | Assign)
Block <- '{' Stmt* '}'
Stmt <- /%fast%/ | Block | 'if' 'constexpr'? '(' Header ')' Stmt ('else' Stmt)? | For | 'while' '(' Header ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'switch' '(' Header ')' Stmt
      | 'case' Cond ('...' Cond)? ':' Stmt? | 'default' ':' Stmt? | 'return' (Init | Expr)? ';' | /(?:break|continue)\b/ ';' | 'goto' Id ';' | Id /:(?!:)/ Stmt? | ';' | CppStmt | Expr ';' | Decl ';'
Header <- (Decl ';')? (Expr | Decl)
For <- 'for' '(' (RangeFor | (Expr | Decl)? ';' Expr? ';' Expr?) ')' Stmt
Unary <- /(?:\+\+|--|&&|[-+!~*&])/ Unary | 'sizeof' ('(' TypeName ')' | Unary) | '(' TypeName ')' (Init Tail* | Unary) | CppUnary | Postfix
TypeName <- Spec Abstract
Postfix <- Primary Tail*
Tail <- '[' Expr ']' | Args | /\.(?!\.)|->/ Path | /\+\+|--/ | BraceInit
Args <- '(' ((Init | Assign) (',' (Init | Assign))*)? ')'
Primary <- Num | Str+ | Chr | '(' Expr ')' | CppPrimary | Path
Num <- /(?:0[xX][\da-fA-F']+|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d+)(?:[eE][+-]?\d+)?)[uUlLfFzZ]*(?!\w)/
Str <- /(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*"(?:\w+)?|R"(\w*)\((?:(?!\)\1")[\s\S])*\)\1"/
Chr <- /(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'/
Id <- /%id%/
%expr%
%dialect%
"""
_C_ONLY = r"""
Path <- Id
Bases <- !~/(?:)/
Access <- !~/(?:)/
CppMember <- !~/(?:)/
CppTop <- !~/(?:)/
CppStmt <- !~/(?:)/
CppUnary <- '_Generic' '(' Assign (',' (Spec Abstract | 'default') ':' Assign)+ ')'
CppPrimary <- !~/(?:)/
BraceInit <- !~/(?:)/
OpName <- !~/(?:)/
CtorInit <- !~/(?:)/
RangeFor <- !~/(?:)/
Trail <- !~/(?:)/
"""
_CPP_ONLY = r"""
Path <- '::'? Seg ('::' (OpName | '~'? Seg))*
Seg <- Id TArgs?
TArgs <- '<' (TArg (',' TArg)*)? '>'
TArg <- (TypeName | Unary) '...'? &~/[,>]/ | Unary
Bases <- 'final'? ':' Base (',' Base)*
Base <- /(?:public|private|protected|virtual)\b/* Path
Access <- /(?:public|private|protected)\b/ ':'
CppMember <- Template Member | 'friend' Top | 'using' ~/[^;{}]+/ ';' | Special | Attr* Spec Declarator CtorInit? (Block | '=' /(?:default|delete|0)/ ';')
Special <- /(?:explicit|constexpr|inline|virtual)\b/* '~'? Path '(' Params? ')' Trail* CtorInit? (Block | '=' /(?:default|delete)\b/ ';' | ';')
CppTop <- 'namespace' (Id ('::' Id)*)? '{' Top* '}' | 'using' ~/[^;{}]+/ ';' | Template Top | 'extern' Str ('{' Top* '}' | Top) | Special
Template <- 'template' '<' (TParam (',' TParam)*)? '>'
TParam <- /(?:typename|class)\b/ '...'? Id? ('=' TypeName)? | Spec Declarator? ('=' Unary)?
CppStmt <- 'try' Block ('catch' '(' ('...' | Param) ')' Block)+ | 'throw' Expr? ';' | 'using' ~/[^;{}]+/ ';' | 'co_return' Expr? ';'
CppUnary <- 'new' TypeName (Args | Init)? | 'delete' ('[' ']')? Unary | /(?:static|dynamic|const|reinterpret)_cast\b/ '<' TypeName '>' '(' Expr ')' Tail* | 'throw' Assign | Lambda Tail* | 'co_await' Unary
Lambda <- '[' (Cap (',' Cap)*)? ']' ('(' Params? ')')? Trail* Block
Cap <- /[&=]?/ 'this' | /[&]?/ Id ('=' Assign)? '...'? | /[&=]/
CppPrimary <- /(?:this|nullptr|true|false)\b/ | Builtin (Args | Init) | 'typeid' '(' (TypeName | Expr) ')'
BraceInit <- Init
OpName <- 'operator' (/(?:\(\)|\[\]|->\*?|[-+*\/%^&|~!=<>]{1,3}|,)/ | TypeName)
CtorInit <- ':' Path (Args | Init) (',' Path (Args | Init))*
RangeFor <- (Expr ';' | Decl ';')? Attr* Spec (Declarator | Ptr* '[' Id (',' Id)* ']') ':' (Init | Expr)
Trail <- /(?:const|noexcept|override|final|volatile|mutable)\b/ | /&&?/ | '->' TypeName
"""


def _c(cpp: bool) -> Grammar:
    ident = rf"(?!(?:{_CPP_RESERVED if cpp else _C_RESERVED})\b){_ID}"
    kinds = r"(?:int|auto|const char \*|const std::string|char)" if cpp else r"(?:int|const char \*|char)"
    fast = _fast(_C_SPACE, ident, rf"{kinds} ?ID = (?:SIMPLE|{_CHR});", "CALL;", "return SIMPLE;")
    text = _expand(
        _C, fast=fast, id=ident, tags=r"(?:struct|union|class)\b" if cpp else r"(?:struct|union)\b", refs="&&?" if cpp else r"(?!)",
        qual=_words("const static extern inline volatile register restrict _Noreturn _Thread_local _Atomic") + ("|" + _words("constexpr virtual mutable thread_local explicit friend typename") if cpp else ""),
        builtin=_words("unsigned signed long short int char float double void _Bool bool auto wchar_t char8_t char16_t char32_t size_t"))
    return Grammar(text.replace("%expr%", _CEXPR).replace("%dialect%", _CPP_ONLY if cpp else _C_ONLY), _PP_SPACE)


_JAVA_RESERVED = _words("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null")
_JAVA = r"""
Start <- (Anno* 'package' Name ';')? (';' | 'import' 'static'? Name ('.' '*')? ';')* (';' | TypeDecl)*
Name <- Id ('.' Id)*
Anno <- '@' !'interface' Name ('(' (Value (',' Value)*)? ')')?
Value <- (Id /=(?!=)/)? (Anno | '{' (Value (',' Value)* ','?)? '}' | Cond)
Mod <- Anno | /(?:public|private|protected|static|final|abstract|native|synchronized|transient|volatile|strictfp|default|sealed)\b(?!\s*[:(])|non-sealed\b/
TypeDecl <- Mod* ('class' Id TParams? ('extends' Type)? Impl? Permits? Body | 'interface' Id TParams? ('extends' Types)? Permits? Body | '@' 'interface' Id Body | 'record' Id TParams? Params Impl? Body | 'enum' Id Impl? '{' (Const (',' Const)* ','?)? (';' Member*)? '}')
Impl <- 'implements' Types
Permits <- 'permits' Types
Types <- Type (',' Type)*
Const <- Anno* Id Args? Body?
Body <- '{' Member* '}'
Member <- ';' | TypeDecl | 'static'? Block | Mod* TParams? (Id Params Throws? Block | Id Block | Type Id Params ('[' ']')* Throws? (Block | ('default' Value)? ';') | Type Dims (',' Dims)* ';')
Throws <- 'throws' Types
Params <- '(' (Param (',' Param)*)? ')'
Param <- Mod* Type '...'? (Id | 'this') ('[' ']')*
Dims <- Id ('[' ']')* ('=' Init)?
Init <- '{' (Init (',' Init)* ','?)? '}' | Assign
TParams <- '<' Anno* Id ('extends' Type ('&' Type)*)? (',' Anno* Id ('extends' Type ('&' Type)*)?)* '>'
Type <- Anno* (/(?:int|long|short|byte|char|boolean|float|double|void|var)\b/ | Id TArgs? ('.' Id TArgs?)*) (Anno* '[' ']')*
TArgs <- '<' (TArg (',' TArg)*)? '>'
TArg <- '?' (/(?:extends|super)\b/ Type)? | Type
Block <- '{' Stmt* '}'
Stmt <- /%fast%/ | Block | ';' | 'if' '(' Expr ')' Stmt ('else' Stmt)? | For | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'return' Expr? ';' | 'throw' Expr ';' | /(?:break|continue)\b/ Id? ';' | 'yield' Expr ';' | 'assert' Cond (':' Cond)? ';'
      | 'synchronized' '(' Expr ')' Block | Switch | Try | Id /:(?!:)/ Stmt | TypeDecl | Local ';' | Expr ';'
Local <- Mod* Type Dims (',' Dims)*
For <- 'for' '(' (Mod* Type Id ':' Expr | (Local | Expr)? ';' Expr? ';' Expr?) ')' Stmt
Switch <- 'switch' '(' Expr ')' '{' (('case' Label (',' Label)* ('when' Cond)? | 'default') ('->' (Block | 'throw' Expr ';' | Expr ';') | ':' Stmt*))* '}'
Label <- 'default' | Type Id | Cond
Try <- 'try' ('(' Res (';' Res)* ';'? ')')? Block ('catch' '(' Mod* Type ('|' Type)* Id ')' Block)* ('finally' Block)?
Res <- Mod* Type Id '=' Assign | Postfix
Expr <- Assign
Assign <- Lambda | Cond (/(?:>>>|<<|>>|[-+*\/%&|^])?=(?!=)/ Assign)?
Lambda <- (Id | '(' ((Param (',' Param)*) | Id (',' Id)*)? ')') '->' (Block | Assign)
Cond <- Binary ('?' Assign ':' (Lambda | Cond))?
Binary <- Unary (/(?:==|!=|<=|>=|>>>|<<|>>|&&|\|\||[-+*%<>&|^]|\/(?![\/*]))(?!=)/ Unary | 'instanceof' Mod* Type Id?)*
Unary <- /\+\+|--|[-+!~]/ Unary | '(' Type ('&' Type)* ')' (Lambda | Unary) | Postfix
Postfix <- Primary Tail* /\+\+|--/*
Tail <- '.' ('new' Creator | 'class' | /(?:this|super)\b/ | TArgs? Id) Args? | '[' Expr ']' | Args | '::' ('new' | Id)
Args <- '(' (Assign (',' Assign)*)? ')'
Creator <- Type ('[' Expr ']')* (Init | Args Body?)? ('[' ']')*
Primary <- 'new' Creator | Switch | Num | Text | Str | Chr | '(' Expr ')' | /(?:this|super|null|true|false)\b/ | Id | Type &~/(?:\.\s*class|::)/
Num <- /(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w)/
Text <- /\"\"\"[ \t]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"/
Str <- /%str%/
Chr <- /%chr%/
Id <- /%id%/
"""


def _java() -> Grammar:
    ident = rf"(?!(?:{_JAVA_RESERVED})\b)(?:[^\W\d]|\$)[\w$]*"
    fast = _fast(_C_SPACE, ident, rf"(?:int|String|char) ID = (?:SIMPLE|{_CHR});", "CALL;", "return SIMPLE;")
    return Grammar(_expand(_JAVA, fast=fast, id=ident, str=_STR, chr=_CHR), _C_SPACE)


# ---------------------------------------------------------------- Go and Rust

_GO_RESERVED = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
_GO = r"""
Start <- 'package' Id End ('import' (Imp End | '(' (Imp End)* ')' End))* (Top End)*
End <- ';'+ | &~/[)}]/ | ~/(?<=\n\s*)/ | ~/(?<=\n\s*(?:\/\/[^\n]*|\/\*(?:[^*]|\*(?!\/))*\*\/)\s*)/ | !~/[\s\S]/
Imp <- /[._]/? Id? Str
Top <- Const | Var | TypeDecl | Func
Const <- 'const' (CSpec | '(' (CSpec End)* ')')
CSpec <- Ids (Type? '=' Exprs)?
Var <- 'var' (VSpec | '(' (VSpec End)* ')')
VSpec <- Ids (Type ('=' Exprs)? | '=' Exprs)
TypeDecl <- 'type' (TSpec | '(' (TSpec End)* ')')
TSpec <- Id TParams? '='? Type
TParams <- '[' Ids Union (',' Ids Union)* ','? ']'
Union <- '~'? Type ('|' '~'? Type)*
Func <- 'func' Params? Id TParams? Sig Block?
Sig <- Params (Params | Type)?
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- Ids '...'? Type | '...'? Type
Ids <- Id (',' Id)*
Type <- '*' Type | '[' (']' | '...' ']' | Expr ']') Type | 'map' '[' Type ']' Type | '<-'? 'chan' '<-'? Type | 'func' Sig | Struct | Interface | '(' Type ')' | Id ('.' Id)? ('[' Type (',' Type)* ']')?
Struct <- 'struct' '{' ((Ids Type | '*'? Id ('.' Id)?) Str? End)* '}'
Interface <- 'interface' '{' ((Id Sig | Union) End)* '}'
Block <- '{' (Stmt End)* '}'
Stmt <- /%fast%/ | Const | Var | TypeDecl | Block | If | For | Switch | Select | 'return' Exprs? | /(?:break|continue)\b/ Id? | 'goto' Id | 'fallthrough' | /(?:go|defer)\b/ Expr | Id /:(?!=)/ Stmt? | Simple | &~/;/
Simple <- Exprs (/:=|(?:<<|>>|&\^|[-+*\/%&|^])?=(?!=)/ Exprs | /\+\+|--/ | '<-' Expr)?
Head <- HExprs (/:=|(?:<<|>>|&\^|[-+*\/%&|^])?=(?!=)/ HExprs | /\+\+|--/ | '<-' HExpr)?
If <- 'if' (Head? ';')? HExpr Block ('else' (If | Block))?
For <- 'for' (Block | (HExprs /:?=/)? 'range' HExpr Block | Head? ';' HExpr? ';' Head? Block | HExpr Block)
Switch <- 'switch' (Head? ';')? (Head)? '{' (('case' CaseItem (',' CaseItem)* | 'default') ':' (Stmt End)*)* '}'
CaseItem <- Expr | Type
Select <- 'select' '{' (('case' Simple | 'default') ':' (Stmt End)*)* '}'
Exprs <- Expr (',' Expr)*
HExprs <- HExpr (',' HExpr)*
Expr <- Unary (Op Unary)*
HExpr <- HUnary (Op HUnary)*
Op <- /(?:==|!=|<=|>=|<<|>>|&&|\|\||&\^|[-+*%<>&|^]|\/(?![\/*]))(?!=)/
Unary <- /<-|[-+!^*&]/ Unary | Primary Tail* Lit? Tail*
HUnary <- /<-|[-+!^*&]/ HUnary | Primary Tail*
Lit <- '{' (Elem (',' Elem)* ','?)? '}'
Elem <- (Lit | Expr) (':' (Lit | Expr))?
Tail <- !Broken ('.' (Id | '(' (Type | 'type') ')') | '[' (Expr? ':' Expr? (':' Expr)? | Expr (',' Expr)*) ','? ']' | '(' (Arg (',' Arg)* '...'? ','?)? ')')
Broken <- ~/(?<=\n\s*)[(\[]/
Arg <- Expr | Type
Primary <- 'func' Sig Block | Num | Str | Chr | TypeLit Lit | TypeLit '(' Expr ')' | '(' (Expr | Type) ')' | Id
TypeLit <- &~/[\[*]|map\b|struct\b|chan\b|interface\b/ Type
Num <- /(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d+)(?:[eE][+-]?\d+)?)i?(?!\w)/
Str <- /"(?:[^"\\\n]|\\.)*"|`[^`]*`/
Chr <- /'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|.))'/
Id <- /%id%/
"""


def _go() -> Grammar:
    ident = rf"(?!(?:{_GO_RESERVED})\b){_ID}"
    fast = _fast(r"[ \t]*(?:;|(?=\r?\n|\}))" + _C_SPACE, ident, "ID := SIMPLE", "CALL", "return SIMPLE")
    # the run must leave its last statement's end to End: a line break before, or a brace after
    return Grammar(_expand(_GO, fast=fast, id=ident), _C_SPACE)


_RUST_RESERVED = _words("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn")
_RUST_SPACE = r"(?>(?:\s+|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)*)"
_RUST = r"""
Start <- ~/#!(?!\[)[^\n]*/? Inner* Item*
Inner <- '#' '!' Tree
Attr <- '#' Tree
Tree <- '[' Tok* ']' | '(' Tok* ')' | '{' Tok* '}'
Tok <- Tree | Str | Chr | Life | /[^\s\[\](){}"'\/]+|\/(?![\/*])/
Vis <- 'pub' ('(' ('in' Path | /(?:crate|self|super)\b/) ')')?
Item <- Attr* Vis? (Use | Const | Fn | Struct | Enum | Impl | Trait | 'mod' Id (';' | '{' Inner* Item* '}') | 'type' Id Gen? (':' Bounds)? Where? ('=' Type)? ';' | 'extern' 'crate' Id ('as' Id)? ';' | 'extern' Str? '{' Item* '}' | MacroItem)
MacroItem <- !Keyword Path '!' Id? ('{' Tok* '}' | ('(' Tok* ')' | '[' Tok* ']') ';')
Keyword <- /(?:%kw%)\b/ !~/::/
Use <- 'use' UseTree ';'
UseTree <- '::'? (/(?:crate|self|super)\b/ | Id) ('::' (UseTree | '{' (UseTree (',' UseTree)* ','?)? '}' | '*'))? ('as' (Id | '_'))? | '{' (UseTree (',' UseTree)* ','?)? '}' | '*'
Const <- /(?:const|static)\b/ !'fn' 'mut'? (Id | '_') ':' Type ('=' Expr)? ';'
Fn <- /(?:const|async|unsafe)\b/* ('extern' Str?)? 'fn' Id Gen? '(' (FnParam (',' FnParam)* ','?)? ')' ('->' Type)? Where? (Block | ';')
FnParam <- Attr* (('&' Life?)? 'mut'? 'self' (':' Type)? | Pat ':' ('...' | Type))
Gen <- '<' (GenP (',' GenP)* ','?)? '>'
GenP <- Attr* (Life (':' Life ('+' Life)*)? | 'const' Id ':' Type ('=' Unary)? | Id (':' Bounds?)? ('=' Type)?)
Where <- 'where' (WPred (',' WPred)* ','?)?
WPred <- Life ':' Life | ('for' Gen)? Type ':' Bounds
Bounds <- Bound ('+' Bound)* '+'?
Bound <- Life | '?'? ('for' Gen)? Path | '(' Bound ')'
Struct <- /(?:struct|union)\b/ Id Gen? (';' | Where? '{' (Field (',' Field)* ','?)? '}' | '(' (Attr* Vis? Type (',' Attr* Vis? Type)* ','?)? ')' Where? ';')
Field <- Attr* Vis? Id ':' Type
Enum <- 'enum' Id Gen? Where? '{' (Variant (',' Variant)* ','?)? '}'
Variant <- Attr* Vis? Id ('{' (Field (',' Field)* ','?)? '}' | '(' (Attr* Type (',' Attr* Type)* ','?)? ')')? ('=' Expr)?
Impl <- 'unsafe'? 'impl' Gen? 'const'? '!'? Type ('for' Type)? Where? '{' Inner* Item* '}'
Trait <- 'unsafe'? 'trait' Id Gen? (':' Bounds?)? Where? '{' Item* '}'
Type <- '&' '&'? Life? 'mut'? Type | '&&' Type | '*' /(?:const|mut)\b/ Type | '[' Type (';' Expr)? ']' | '(' (Type (',' Type)* ','?)? ')' | '!' | '_' | ('for' Gen)? /(?:unsafe|extern)\b/* Str? 'fn' '(' ((Id ':')? Type (',' (Id ':')? Type)* ','?)? ')' ('->' Type)? | /(?:dyn|impl)\b/ Bounds | Path
Path <- '::'? Seg ('::' Seg)* | '<' Type ('as' Type)? '>' ('::' Seg)+
Seg <- (/(?:crate|self|Self|super)\b/ | Id) ('::'? TArgs | '(' (Type (',' Type)* ','?)? ')' ('->' Type)?)?
ESeg <- (/(?:crate|self|Self|super)\b/ | Id) ('::' TArgs)?
EPath <- '::'? ESeg ('::' ESeg)* | '<' Type ('as' Type)? '>' ('::' ESeg)+
TArgs <- '<' (TArg (',' TArg)* ','?)? '>'
TArg <- Life | Id '=' Type | Id ':' Bounds | Type | Block | '-'? Num
Block <- '{' Inner* Stmt* Expr? '}'
Stmt <- /%fast%/ | ';' | Attr* 'let' Pat (':' Type)? ('=' Expr ('else' Block)?)? ';' | !MacroItem !(('unsafe' | 'const' | 'async' 'move'?) Block) Item | Attr* BlockLike !~/[.?]/ | MacroBrace | Expr ';'
MacroBrace <- EPath '!' '{' Tok* '}' !~/[.?]/
BlockLike <- (Life ':')? (If | Match | Loop | Block) | /(?:unsafe|async|const)\b/ 'move'? Block
If <- 'if' Cond Block ('else' (If | Block))?
Cond <- ('let' Pat '=' NoStruct | NoStruct) ('&&' ('let' Pat '=' NoStruct | NoStruct))*
Match <- 'match' NoStruct '{' Inner* (Attr* Pat ('if' Cond)? '=>' (BlockLike ','? | Expr ','?))* '}'
Loop <- 'loop' Block | 'while' Cond Block | 'for' Pat 'in' NoStruct Block
Pat <- '|'? PatOne ('|' PatOne)*
PatOne <- '&&' PatOne | '&' 'mut'? PatOne | '(' (Pat (',' Pat)* ','?)? ')' | '[' (Pat (',' Pat)* ','?)? ']' | 'box' PatOne | Range | 'ref'? 'mut'? Id '@' PatOne | /(?:ref|mut)\b/+ Id | '..' | '_' | EPath '!' Tree | EPath ('{' ((Attr* ('..' | (Id | Num) ':' Pat | /(?:ref|mut)\b/* Id)) (',' Attr* ('..' | (Id | Num) ':' Pat | /(?:ref|mut)\b/* Id))* ','?)? '}' | '(' (Pat (',' Pat)* ','?)? ')')?
Range <- Bound2 '..=' Bound2 | Bound2 /\.\.(?!=)/ Bound2? | '..=' Bound2 | '-'? Num | Str | Chr | /(?:true|false)\b/
Bound2 <- '-'? Num | Chr | EPath
Expr <- Attr* (Jump | Closure | Bin (/(?:<<|>>|[-+*\/%&|^])?=(?![=>])/ Expr)?)
NoStruct <- Jump | Closure | NBin (/(?:<<|>>|[-+*\/%&|^])?=(?![=>])/ NoStruct)?
Jump <- 'return' Expr? | 'break' Life? Expr? | 'continue' Life?
Closure <- /(?:static|async|move)\b/* ('||' | '|' (PatOne (':' Type)? (',' PatOne (':' Type)?)* ','?)? '|') ('->' Type Block | Expr)
Bin <- (Unary (Op Unary | 'as' Type)*)? RangeOp Bin? | Unary (Op Unary | 'as' Type)* 
NBin <- NUnary (Op NUnary | 'as' Type)* (RangeOp NBin?)? | RangeOp NBin?
RangeOp <- /\.\.=?/
Op <- /(?:==|!=|<=|>=|<<|>>|&&|\|\||[-+*%<>&|^]|\/(?![\/*]))(?!=)/
Unary <- /[-!*]|&&?/ ('mut' | 'raw' /(?:const|mut)\b/)? Unary | Closure | Primary Tail*
NUnary <- /[-!*]|&&?/ 'mut'? NUnary | Closure | NPrimary Tail*
Tail <- '?' | '.' 'await' | '.' /\d+(?![\w.])/ | '.' ESeg | '[' Expr ']' | '(' (Expr (',' Expr)* ','?)? ')'
Primary <- Struct2 | NPrimary
Struct2 <- EPath '{' (Attr* ('..' Expr? | (Id | Num) (':' Expr)?) (',' Attr* ('..' Expr? | (Id | Num) (':' Expr)?))* ','?)? '}'
NPrimary <- Num | Str | Chr | /(?:true|false)\b/ | EPath '!' Tree | (Life ':')? (If | Match | Loop | Block) | /(?:unsafe|async|const)\b/ 'move'? Block | '(' (Expr (',' Expr)* ','?)? ')' | '[' (Expr (';' Expr | (',' Expr)* ','?))? ']' | EPath
Num <- /(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iuf]\d+|[iu]size)?(?!\w)/
Str <- /[bc]?"(?:[^"\\]|\\[\s\S])*"|[bc]?r(#*)"(?:(?!"\1)[\s\S])*"\1/
Chr <- /b?'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|.))'/
Life <- /'(?:_|[^\W\d]\w*)(?!')/
Id <- /(?:r#)?%id%/
"""


def _rust() -> Grammar:
    ident = rf"(?!(?:{_RUST_RESERVED})\b){_ID}"
    fast = _fast(_RUST_SPACE, ident, "let ID = SIMPLE;", "CALL;")
    text = _expand(_RUST, fast=fast, id=ident, kw=_RUST_RESERVED.replace("|crate", "").replace("|self|Self", "").replace("|super", ""))
    return Grammar(text, _RUST_SPACE)


# ---------------------------------------------------------------- JSON and TOML

_JSON = r"""
Start <- Value
Value <- Object | Array | /%str%/ | /-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])/ | /(?:true|false|null)\b/
Object <- '{' (Pair (',' Pair)*)? '}'
Pair <- /%str%/ ':' Value
Array <- '[' (/(?>-?(?:0|[1-9]\d*)(?:\.\d+)?[ \t\r\n]*,[ \t\r\n]*)+(?=[-\d])/? Value (',' Value)*)? ']'
"""
_JSON_STR = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'

_TOML = r"""
Start <- Line*
Line <- Table Eol | Pair Eol | Eol1
Eol <- Comment? (Nl | !~/[\s\S]/)
Eol1 <- Comment (Nl | !~/[\s\S]/) | Nl
Comment <- ~/#[^\x00-\x08\x0a-\x1f\x7f]*/
Nl <- /\r?\n/
Table <- '[[' Key ~/\]\][ \t]*/ | '[' Key ']'
Pair <- Key '=' Value
Key <- Part ('.' Part)*
Part <- /[A-Za-z0-9_-]+/ | Basic | Literal
Value <- MBasic | MLiteral | Basic | Literal | Array | Inline | Date | Number | /(?:true|false)(?![\w-])/
Array <- '[' Gap (Value Gap (',' Gap Value Gap)* (',' Gap)?)? ']'
Gap <- (Comment? Nl)*
Inline <- '{' (Pair (',' Pair)*)? '}'
Basic <- /"(?!"")(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|""(?!")/
Literal <- /'(?!'')[^'\x00-\x08\x0a-\x1f\x7f]*'|''(?!')/
MBasic <- /\"\"\"(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n\s*)|"(?!""))*\"{3,5}/
MLiteral <- /'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'(?!''))*'{3,5}/
Date <- /\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?(?![\w.:])|\d\d:\d\d:\d\d(?:\.\d+)?(?![\w.:])/
Number <- /(?:0x[\da-fA-F]+(?:_[\da-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w.+-])/
"""

# ---------------------------------------------------------------- Ruby and shell

#: ``retry`` is left out knowingly: Ruby reserves it, yet the tables' Ruby uses it as a plain name
#: throughout, and whether a name may be used is not what this operator is asked to find.
_RB_RESERVED = _words("alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue return self super then true undef unless until when while yield")
_RB_SPACE = r"(?>(?:[ \t\r]+|\\\n)*)"
_RB = r"""
Start <- Stmts ~/__END__\r?\n[\s\S]*/?
Stmts <- Sep* (Stmt (Sep+ | &Stop))*
Sep <- /(?:#[^\n]*)?\n(?:=begin\b[\s\S]*?\n=end\b[^\n]*)?|;|#[^\n]*(?![\s\S])/
Stop <- ~/(?:end|else|elsif|when|in|rescue|ensure|then|__END__)\b|[})]/ | !~/[\s\S]/
Stmt <- /%fast%/ | Base Modifier*
Modifier <- /(?:if|unless|while|until|rescue)\b/ ExprAnd
Base <- ExprAnd
ExprAnd <- Not (/(?:and|or)\b/ Nl* Not)*
Not <- 'not' Not | Expr
Nl <- /(?:#[^\n]*)?\n/
Expr <- Multi | Assign
Multi <- Star (',' Star)+ '=' !~/[=~>]/ Nl* Assign (',' Nl* Assign)*
Star <- '*'? Post
Assign <- Post /(?:\*\*|<<|>>|&&|\|\||[-+*\/%&|^])?=(?![=~>])/ Nl* ('*'? Assign (',' Nl* '*'? Assign)* ('rescue' Assign)?) | Tern
Tern <- Bin ('?' Nl* Tern Nl* ':' Nl* Tern)?
Bin <- Un (BinOp Nl* Un)*
BinOp <- /<=>|===|==|=~|!=|!~|<=|>=|<<|>>|&&|\|\||\*\*|\.\.\.?|[-+*\/%<>&|^](?!=)/
Un <- /[-+!~&]|\*\*?|defined\?/ Un | Post
Post <- Prim Tail*
Tail <- Lead? /&?\.(?!\.)|::/ Nl* (Meth (/(?<=[\w?!])(?=\()/ Paren | Cmd)? | Paren) Blk? | /(?<=[\w?!\])}])(?=\[)/ '[' Args? ']' | Blk
Lead <- &~/(?:[ \t]*(?:#[^\n]*)?\n)+[ \t]*&?\.[^.]/ Nl+
Meth <- /[^\W\d]\w*[?!]?|[-+*\/%<>=]=?|\[\]=?/
Blk <- 'do' ('|' Params? '|')? Body 'end' | '{' ('|' Params? '|')? Stmts '}'
Params <- Param (/[,;]/ Nl* Param)*
Param <- /\*\*|[*&]/? (Name | '(' Params ')')? ('=' Tern | /:(?!:)/ Tern?)?
Name <- /%id%/
Paren <- ~/\(/ ~/\s*/ Nl* Args? Nl* ')'
Cmd <- !~/(?:do|if|unless|while|until|and|or|then|rescue|end)\b|[-+*&\[\/<%?:|=]\s|[-+*\/<>=|&]=|[.,;)}\]]|=|\{|\|/ ~/(?<=[ \t])/ CArgs
CArgs <- CArg (',' Nl* CArg)*
CArg <- /\*\*|[*&]/? (Pair | Not)
Args <- Arg (',' Nl* Arg)* ','? Nl*
Arg <- Nl* (/\*\*|[*&]/? (Pair | Not)) Nl*
Pair <- (/[^\W\d]\w*[?!]?:(?!:)/ | /"(?:[^"\\]|\\[\s\S])*":/) Nl* Not? | Tern '=>' Nl* Not
Prim <- Def | Class | If | While | Case | Begin | For | Lambda | 'yield' (Paren | Cmd)? | /(?:return|break|next)\b/ (Args1)? | 'redo' | /(?:super)\b/ (Paren | Cmd)? | Str | Num | Sym | Array | Hash | Regex | Words | /(?:nil|true|false|self|__FILE__|__LINE__|__dir__)\b/ | '(' Stmts ')' | Var | Call | 'alias' /\S+[ \t]+\S+/ | 'undef' /\S+/ | /::[A-Z]\w*/
Args1 <- !~/(?:if|unless|while|until|end)\b|[\n;})]/ Arg (',' Nl* Arg)*
Var <- /@@?%bare%|\$(?:%bare%|[0-9~&`'+!@\/\;,.<>_*$?:"])/
Call <- /%id%[?!]?/ ((/(?<=[\w?!])(?=\()/ | &~/\(/) Paren | Cmd)? Blk?
Def <- 'def' (('self' | Name) '.')? DName (Paren2 | (Params)?) (/=(?![=~])/ Nl* Stmt | Body 'end')
DName <- /[^\W\d]\w*[?!=]?(?=[\s(;])|\[\]=?|<=>|===?|=~|[-+!~]@?|\*\*|[*\/%<>&|^]|<<|>>|<=|>=/
Paren2 <- ~/\(/ ~/\s*/ Params? ~/\s*/ ')'
Body <- Stmts ('rescue' ~/[^\n;]*/ 'then'? Stmts)* ('else' Stmts)? ('ensure' Stmts)?
Class <- 'class' ('<<' Expr | Const ('<' Expr)?) Body 'end' | 'module' Const Body 'end'
Const <- /(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*/
Then <- 'then' | Sep+ 'then'? 
If <- /(?:if|unless)\b/ Stmt Then Stmts ('elsif' Stmt Then Stmts)* ('else' Stmts)? 'end'
While <- /(?:while|until)\b/ CondNoDo ('do' | Sep) Stmts 'end'
CondNoDo <- Bin2 (/(?:and|or)\b/ Bin2)*
Bin2 <- Un2 (BinOp Nl* Un2)*
Un2 <- /[-+!]/ Un2 | Prim (!~/do\b/ Tail)*
Case <- 'case' Stmt? Sep+ (/(?:when|in)\b/ CArgs Then Stmts)+ ('else' Stmts)? 'end'
Begin <- 'begin' Body 'end'
For <- 'for' Name (',' Name)* 'in' CondNoDo ('do' | Sep) Stmts 'end'
Lambda <- '->' (Paren2 | Params)? Blk
Str <- (~/"/ (~/(?:[^"\\#]|\\[\s\S]|#(?![{]))+/ | Interp)* /"/ | /'(?:[^'\\]|\\[\s\S])*'/ | ~/`/ (~/(?:[^`\\#]|\\[\s\S]|#(?![{]))+/ | Interp)* /`/ | /<<[~-]?(['"]?)\w+\1/ | /%[qQ]?(?:\((?:[^()\\]|\\[\s\S]|\([^()]*\))*\)|\{(?:[^{}\\]|\\[\s\S]|\{[^{}]*\})*\}|\[(?:[^\]\\]|\\[\s\S])*\])/ | /\?[a-zA-Z](?!\w)/)+
Interp <- ~/#\{\s*/ Stmts ~/\}/
Words <- /%[wWiI](?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>)/
Num <- /(?:0[xX][\da-fA-F_]+|0[bB][01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[ri]?(?!\w)/
Sym <- /:(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*[?!]?|"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\]|\\[\s\S])*'|\[\]=?|<=>|===?|=~|[-+!~]@?|\*\*|[*\/%<>&|^]|<<|>>)/
Array <- '[' Nl* Args? Nl* ']'
Hash <- '{' Nl* ((Pair | '**' Expr) Nl* (',' Nl* (Pair | '**' Expr) Nl*)* ','? Nl*)? '}'
Regex <- ~/\/(?![\s=])/ (~/(?:[^\/\\\n#]|\\.|#(?!\{))+/ | Interp)* /\/[a-z]*/
"""


def _ruby() -> Grammar:
    ident = rf"(?!(?:{_RB_RESERVED})(?![\w?!]))[^\W\d]\w*"
    atom = rf"(?:{ident}(?:\[\d+\])?|\d+|\"(?:[^\"\\#\n]|\\.)*\")"
    call = rf"{ident}\({ident}(?:, {ident})*\)"
    fast = rf"(?:{ident} = )?(?:{call}|{atom}(?: [-+*] {atom})?)(?=[ \t]*\r?\n)"
    return Grammar(_expand(_RB, fast=fast, id=ident, bare=_ID), _RB_SPACE)


_SH_SPACE = r"(?>(?:[ \t]+|\\\r?\n)*)"
_SH = r"""
Start <- List?
List <- Nl* Chain ((/(?:&(?!&)|;(?!;))/ Nl* | Nl+) Chain)* (/(?:&(?!&)|;(?!;))/)? Nl*
Nl <- /(?:#[^\n]*)?\r?\n|#[^\n]*(?![\s\S])/
Chain <- Pipe (/&&|\|\|/ Nl* Pipe)*
Pipe <- (/!(?=\s)/ | 'time')? Command (/\|&?(?!\|)/ Nl* Command)*
Command <- /%fast%/ | FuncDef | Compound Redir* | Simple
FuncDef <- 'function' Word ('(' ')')? Nl* Compound Redir* | !Reserved /[^\W\d][\w.:-]*(?=[ \t]*\(\))/ '(' ')' Nl* Compound Redir*
Compound <- If | Loop | For | Case | Group | Arith | '(' List ')' | Test
If <- 'if' List 'then' List ('elif' List 'then' List)* ('else' List)? 'fi'
Loop <- /(?:while|until)\b/ List 'do' List 'done'
For <- /(?:for|select)\b/ ('((' ~/[^()]*(?:\([^()]*\)[^()]*)*/ '))' | /[^\W\d]\w*/ (Nl* 'in' Word*)?) (';' | Nl)* Nl* 'do' List 'done'
Case <- 'case' Word Nl* 'in' Nl* ('('? Word ('|' Word)* ')' Nl* List? (/;;&|;;|;&/ Nl* | &~/esac\b/))* 'esac'
Group <- /\{(?=\s)/ List '}'
Test <- /\[\[(?=\s)/ (!~/\]\](?=[\s;&|)]|$)/ (Word | /&&|\|\||[()<>!]|=~/ | Nl))+ ']]'
Arith <- '((' ~/(?:[^()]|\((?:[^()]|\([^()]*\))*\))*/ '))'
Simple <- !Reserved (Assign | Redir)* Word? (Arg | Redir)* &~/(?<=[^\s;&|(])|(?<=[^\s;&|(]\s+)/
Arg <- AssignArr | Word
Assign <- AssignArr | &~/[^\W\d]\w*(?:\[[^\]]*\])?\+?=/ Word
AssignArr <- ~/[^\W\d]\w*\+?=\(/ ~/\s*/ (Word | Nl)* ')'
Redir <- /\d*(?:&>>?|>>|>\||>&|<&|<>|<<<|<<-?|[<>](?!\())/ Word | /\{\w+\}[<>]/ Word
Reserved <- ~/(?:if|then|else|elif|fi|do|done|case|esac|while|until|for|in|function|select)(?=[\s;&|()<>]|$)|[{}](?=[\s;]|$)|\[\[(?=\s)/
Word <- (Part+) ~/[ \t]*(?:\\\r?\n[ \t]*)*/
Part <- ~/[^\s\\'"`$|&;()<>#]+(?:#[^\s\\'"`$|&;()<>]*)*/ | ~/\\[\s\S]/ | ~/'[^']*'/ | DQ | Dollar | Tick | ~/[<>]\(/ List ~/\)/ | ~/(?<=\S)#/
DQ <- ~/"/ (~/(?:[^"\\$`]|\\[\s\S])+/ | Dollar | Tick)* ~/"/
Dollar <- ~/\$\(\(/ ~/(?:[^()]|\((?:[^()]|\([^()]*\))*\))*/ ~/\)\)/ | ~/\$\(\s*/ List? ~/\s*\)/ | ~/\$\{/ (~/(?:[^{}"'\\$`]|\\[\s\S])+/ | ~/'[^']*'/ | DQ | Dollar | Tick)* ~/\}/ | ~/\$'(?:[^'\\]|\\[\s\S])*'/ | ~/\$(?:[^\W\d]\w*|[0-9@*#?$!-])?/
Tick <- ~/`(?:[^`\\]|\\[\s\S])*`/
"""


def _shell() -> Grammar:
    fast = r"(?:local [^\W\d]\w*=(?:\$\(\( [\w$]+ [-+*] [\w$]+ \)\)|[\w.]+|'[^'\n]*'|\"[^\"\\$`\n]*\")|return \d+)(?=[ \t]*\r?\n)"
    return Grammar(_expand(_SH, fast=fast), _SH_SPACE)


_HEREDOC = re.compile(r"(?<![<\w)])<<([~-]?)[ \t]*(['\"]?)([A-Za-z_]\w*)\2")
_SH_HEREDOC = re.compile(r"(?<!<)<<(-?)[ \t]*\\?(['\"]?)([A-Za-z_]\w*)\2")


def _mask_heredocs(text: str, opener: re.Pattern, comment: str) -> str:
    """Blank the bodies of here-documents, keeping length; one that never ends is left alone."""
    out, waiting, at = [], [], 0
    for line in text.splitlines(keepends=True):
        if waiting:
            dash, _, word = waiting[0]
            bare = line.rstrip("\r\n")
            if (bare.strip() if dash else bare) == word:
                waiting.pop(0)
            out.append(" " * (len(line) - 1) + ("\n" if line.endswith("\n") else " "))
            continue
        if "<<" in line and not line.lstrip().startswith(comment):
            waiting = [m.groups() for m in opener.finditer(line)]
        out.append(line)
        at += len(line)
    return text if waiting else "".join(out)


# ---------------------------------------------------------------- Python

_PY_RESERVED = _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield")
#: Line structure is made explicit before parsing: end of a logical line, more and less indent.
_EOL, _IN, _OUT = "\x01", "\x02", "\x03"
_PY_SPACE = r"(?>(?:[ \t\f]+|#[^\n\x01]*)*)"
_PY = r"""
Start <- Line*
Line <- Compound | Small (';' Small)* ';'? Eol
Eol <- ~/\x01/ Sp
Sp <- /(?:)/
Suite <- ':' (Eol ~/\x02/ Sp Line+ ~/\x03/ Sp | Small (';' Small)* ';'? Eol)
Compound <- 'if' Named Suite ('elif' Named Suite)* ('else' Suite)? | 'while' Named Suite ('else' Suite)? | 'async'? 'for' Targets 'in' Stars Suite ('else' Suite)? | Try | 'async'? 'with' With Suite | Deco* ('async'? 'def' Id TPar? '(' Params ')' ('->' Test)? Suite | 'class' Id TPar? ('(' Args? ')')? Suite) | Match
Deco <- '@' Named Eol
TPar <- '[' TP (',' TP)* ','? ']'
TP <- '**' Id ('=' Test)? | '*' Id ('=' Star1)? | Id (':' Test)? ('=' Test)?
Try <- 'try' Suite ((Except+ | ExceptAny+) ('else' Suite)? ('finally' Suite)? | 'finally' Suite)
Except <- 'except' (Test ('as' Id)?)? Suite
ExceptAny <- 'except' '*' Test ('as' Id)? Suite
With <- '(' WItem (',' WItem)* ','? ')' &~/:/ | WItem (',' WItem)*
WItem <- Test ('as' Target1 &~/[,):]/)?
Match <- /match\b(?!\s*[=.,)\]])/ Subject ':' Eol ~/\x02/ Sp (/case\b/ Patterns ('if' Named)? Suite)+ ~/\x03/ Sp
Subject <- StarN ',' (StarN (',' StarN)* ','?)? | Named
Patterns <- StarPat ',' (StarPat (',' StarPat)* ','?)? | Pattern
StarPat <- '*' Id | Pattern
Pattern <- PatOr ('as' !~/_\b/ Id !~/[.(=]/)?
PatOr <- PatOne ('|' PatOne)*
PatOne <- PatLit | '(' (Pattern ')' | (StarPat ',' (StarPat (',' StarPat)* ','?)?)? ')') | '[' (StarPat (',' StarPat)* ','?)? ']' | '{' (PatPair (',' PatPair)* (',' '**' !~/_\b/ Id)? ','? | '**' !~/_\b/ Id ','?)? '}' | Dotted (!~/[(]/ | '(' PatArgs? ')')
PatArgs <- (PatKey | Pattern !~/=/ (',' !PatKey Pattern)* (',' PatKey)?) (',' PatKey)* ','?
PatKey <- Id /=(?!=)/ Pattern
PatLit <- '-'? Num (/[-+]/ Imag)? | Strs | /(?:None|True|False)\b/
PatPair <- (PatLit | Id ('.' Id)+) ':' Pattern
Small <- /%fast%/ | /(?:pass|break|continue)\b/ | 'return' Stars? | 'raise' (Test ('from' Test)?)? | /(?:global|nonlocal)\b/ Id (',' Id)* | 'del' DTarget (',' DTarget)* ','? | 'assert' Test (',' Test)? | 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* | From | /type\b(?=\s+[^\W\d])/ Id TPar? /=(?!=)/ Test | ExprStmt
From <- 'from' (/\.+/+ Dotted? | Dotted) 'import' ('*' | '(' Id ('as' Id)? (',' Id ('as' Id)?)* ','? ')' | Id ('as' Id)? (',' Id ('as' Id)?)*)
Dotted <- Id ('.' Id)*
ExprStmt <- (Targets /=(?!=)/)+ (Yield | Stars) | Single (':' Test (/=(?!=)/ (Yield | Stars))? | /(?:\*\*|\/\/|<<|>>|[-+*\/%@&|^])=/ (Yield | Stars)) | Yield | Stars
More <- ~/[.(\[]/
Place <- Atom (Trailer &More)* ('.' Id | Index) !More | Id !More
Single <- Place | '(' Single ')'
Targets <- Target1 (',' Target1)* ','?
Target1 <- '*' !~/\*/ Target1 | Target
Target <- Place | '(' (Target ')' | (Target1 ',' (Target1 (',' Target1)* ','?)?)? ')') | '[' (Target1 (',' Target1)* ','?)? ']'
DTarget <- Place | '(' (DTarget (',' DTarget)* ','?)? ')' | '[' (DTarget (',' DTarget)* ','?)? ']'
Star1 <- '*' Bin | Test
Stars <- Star1 (',' Star1)* ','?
StarN <- '*' Bin | Named
Yield <- 'yield' ('from' Test | Stars)?
Named <- Id ':=' Test | Test
Test <- Lambda | Or ('if' Or 'else' Test)?
Lambda <- 'lambda' LParams ':' Test
LParams <- (LN+ '/' LC LN* LD* | LN* LD+ '/' LC LD* | LN+ LD* | LD*) LStar?
LStar <- '*' ',' (LD | LN)+ LKey? | '*' LN (LD | LN)* LKey? | LKey
LKey <- '**' LN
LN <- Id !~/=/ LC
LD <- Id '=' Test LC
LC <- ',' | &~/:/
Params <- (PN+ '/' PC PN* PD* | PN* PD+ '/' PC PD* | PN+ PD* | PD*) PStar?
PStar <- '*' ',' (PD | PN)+ PKey? | '*' Id (':' Star1)? !~/=/ PC (PD | PN)* PKey? | PKey
PKey <- '**' PN
PN <- Id (':' Test)? !~/=/ PC
PD <- Id (':' Test)? '=' Test PC
PC <- ',' | &~/\)/
Or <- Not (/(?:or|and)\b/ Not)*
Not <- 'not' Not | Bin (/==|!=|<=|>=|[<>](?![<>])|not\s+in\b|in\b|is\s+not\b|is\b/ Bin)*
Bin <- Unary (/<<|>>|\/\/|\*\*|[-+*\/%@&|^](?!=)/ Unary)*
Unary <- /[-+~]/ Unary | 'await'? Atom Trailer*
Trailer <- '.' Id | '(' (Named CompFor | Args)? ')' | Index
Index <- '[' Sub (',' Sub)* ','? ']'
Args <- (PosArg (',' PosArg)* (',' KeyArgs)? | KeyArgs) ','?
PosArg <- '*' Test | Named !~/=(?!=)/
KeyArgs <- KeyStar (',' KeyStar)* (',' KeyMap)* | KeyMap (',' KeyMap)*
KeyStar <- '*' Test | Id /=(?!=)/ Test
KeyMap <- '**' Test | Id /=(?!=)/ Test
Sub <- Test? /:(?!=)/ Test? (/:(?!=)/ Test?)? | '*' Test | Named
CompFor <- ('async'? 'for' Targets 'in' Or ('if' Or)*)+
Atom <- '(' (Yield | Named CompFor | StarN ',' (StarN (',' StarN)* ','?)? | Named)? ')' | '[' (Named CompFor | StarN (',' StarN)* ','?)? ']' | '{' (Test ':' Test CompFor | Entry (',' Entry)* ','? | Named CompFor | StarN (',' StarN)* ','?)? '}' | Strs | Num | '...' | /(?:None|True|False)\b/ | Id
Entry <- '**' Bin | Test ':' Test
Num <- /(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:%dig%)?\.%dig%(?:[eE][+-]?%dig%)?[jJ]?|%dig%(?:\.(?:[eE][+-]?%dig%)?[jJ]?|[eE][+-]?%dig%[jJ]?|[jJ])|(?:0(?:_?0)*|[1-9](?:_?\d)*)(?!\.))(?:(?!\w)|(?=(?:and|else|for|if|in|is|not|or)\b))/
Imag <- /(?:(?:%dig%)?\.%dig%|%dig%\.?)(?:[eE][+-]?%dig%)?[jJ](?!\w)/
Strs <- Bytes+ !Text | Text+ !Bytes
Bytes <- /[bB](?:%bytes%)|(?:[bB][rR]|[rR][bB])(?:%rawbytes%)/
Text <- FStr | /[uU]?(?:%text%)|[rR](?:%rawtext%)/
FStr <- ~/[fF]\"\"\"/ (~/(?:[^"\\{}]|%esc%|\\(?=[{}])|\{\{|\}\}|"(?!""))+/ | Field)* /\"\"\"/ | ~/[fF]'''/ (~/(?:[^'\\{}]|%esc%|\\(?=[{}])|\{\{|\}\}|'(?!''))+/ | Field)* /'''/
      | ~/[fF]"(?!"")/ (~/(?:[^"\\{}\n]|%esc%|\\(?=[{}])|\{\{|\}\})+/ | Field)* /"/ | ~/[fF]'(?!'')/ (~/(?:[^'\\{}\n]|%esc%|\\(?=[{}])|\{\{|\}\})+/ | Field)* /'/
      | ~/(?:[fF][rR]|[rR][fF])\"\"\"/ (~/(?:[^"\\{}]|\\[^{}]|\\(?=[{}])|\{\{|\}\}|"(?!""))+/ | Field)* /\"\"\"/ | ~/(?:[fF][rR]|[rR][fF])'''/ (~/(?:[^'\\{}]|\\[^{}]|\\(?=[{}])|\{\{|\}\}|'(?!''))+/ | Field)* /'''/
      | ~/(?:[fF][rR]|[rR][fF])"(?!"")/ (~/(?:[^"\\{}\n]|\\[^{}]|\\(?=[{}])|\{\{|\}\})+/ | Field)* /"/ | ~/(?:[fF][rR]|[rR][fF])'(?!'')/ (~/(?:[^'\\{}\n]|\\[^{}]|\\(?=[{}])|\{\{|\}\})+/ | Field)* /'/
Field <- '{' !~/lambda\b/ (Yield | Stars) '='? /![rsa]/? (~/:/ (~/[^{}"'\n]+/ | Field)*)? ~/\}/
Id <- /%id%/
"""


def _py_quoted(escape: str, beyond: str = "") -> str:
    """String literals in their four kinds of quotes; ``beyond`` are characters they can't hold."""
    kinds = (('"""', '"""', '|"(?!"")', ""), ("'''", "'''", "|'(?!'')", ""), ('"(?!"")', '"', "", r"\n"), ("'(?!'')", "'", "", r"\n"))
    return "|".join(rf"{start}(?:[^{q[0]}\\{end}{beyond}]|{escape}{inner})*{q}" for start, q, inner, end in kinds)


def _python() -> Grammar:
    ident = rf"(?!(?:{_PY_RESERVED})\b){_ID}"
    atom = rf"(?:{ident}(?:\[(?:0|[1-9]\d*)\])?|(?:0|[1-9]\d*)(?!\w)|\"[^\"\\\n]*\")"
    call = rf"{ident}\({ident}(?:, {ident})*\)"
    simple = rf"(?:{call}|{atom}(?: [-+*] {atom})?)"
    fast = rf"(?>(?:{ident} = {simple}|{call}|return {simple}|pass)\x01[ \t]*)*(?:{ident} = {simple}|{call}|return {simple}|pass)(?=[ \t]*\x01)"
    hexa = r"[\da-fA-F]"
    more = rf"x{hexa}{{2}}|u{hexa}{{4}}|U(?:000{hexa}|0010){hexa}{{4}}|N\{{[^{{}}\n]+\}}"
    beyond = "\x80-\U0010ffff"
    return Grammar(_expand(
        _PY, fast=fast, id=ident, dig=r"\d(?:_?\d)*", text=_py_quoted(rf"\\(?:[^xuUN]|{more})"), rawtext=_py_quoted(r"\\[\s\S]"), esc=rf"\\(?:[^xuUN{{}}]|{more})",
        bytes=_py_quoted(rf"\\(?:[^x{beyond}]|x{hexa}{{2}})", beyond), rawbytes=_py_quoted(rf"\\[^{beyond}]", beyond)), _PY_SPACE)


_PY_TOKEN = re.compile(
    r'(?P<str>(?:[rRuUbBfF]{0,2})(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'))'
    r"|(?P<com>#[^\n]*)|(?P<join>\\\r?\n)|(?P<nl>\r?\n)|(?P<open>[([{])|(?P<shut>[)\]}])|(?P<rest>(?:[^\"'#\\\n\r()\[\]{}\w]|\w+(?![\w\"']))+|\w+|[\s\S])")
_LEAD = re.compile(r"[ \t\f]*")


def _python_lines(text: str) -> tuple[str, Callable[[int], int]]:
    """Text with its line structure spelled out, and a map from its places to the original's. Bad
    indentation and unclosed brackets come out as a control character no rule takes."""
    out: list[str] = []
    origin: list[int] = []  # original place of each piece
    starts: list[int] = []
    size = 0

    def put(s: str, at: int) -> None:
        nonlocal size
        starts.append(size)
        origin.append(at)
        out.append(s)
        size += len(s)

    at, n, depth = 0, len(text), 0
    levels = [""]
    if "\x01" in text or "\x02" in text or "\x03" in text or "\x00" in text:
        return "\x00", lambda p: 0
    fresh = True
    while at < n:
        if fresh:
            lead = _LEAD.match(text, at).group()
            m = _PY_TOKEN.match(text, at + len(lead))
            if m and (m["nl"] or m["com"]):  # a blank line or one with a comment only
                end = text.find("\n", at)
                at = n if end < 0 else end + 1
                continue
            if at + len(lead) >= n:
                break
            lead = lead.replace("\f", "")
            if lead != levels[-1]:
                if lead.startswith(levels[-1]):
                    levels.append(lead)
                    put(_IN, at)
                else:
                    while len(levels) > 1 and lead != levels[-1]:
                        levels.pop()
                        put(_OUT, at)
                    if lead != levels[-1]:
                        put("\x00", at)
            at += len(_LEAD.match(text, at).group())
            fresh = False
        m = _PY_TOKEN.match(text, at)
        if m["nl"]:
            if depth:
                put(" " * (m.end() - at), at)
            else:
                put(_EOL, at)
                fresh = True
        elif m["join"]:
            put(" " * (m.end() - at) if m.end() < n else "\x00", at)
        elif not m["com"]:
            depth = max(0, depth + bool(m["open"]) - bool(m["shut"]))
            put(m.group(), at)
        at = m.end()
    if not fresh:
        put(_EOL, n)
    for _ in levels[1:]:
        put(_OUT, n)
    return "".join(out), lambda p: (origin[i] + min(p - starts[i], len(out[i]))) if (i := bisect.bisect_right(starts, p) - 1) >= 0 else 0


# ---------------------------------------------------------------- all of them

#: Language of a file name's extension (fixed values).
EXTENSIONS = {"py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "rb": "ruby", "sh": "shell", "json": "json", "toml": "toml"}


@cache
def grammar(language: str) -> Grammar:
    if language == "javascript":
        return _js(_JS_TYPES, "")
    if language == "typescript":
        return _js(_TS_TYPES, "(?:: (?:number|string|boolean))?")
    if language in ("c", "cpp"):
        return _c(language == "cpp")
    if language == "json":
        return Grammar(_expand(_JSON, str=_JSON_STR), _JSON_SPACE)
    if language == "toml":
        return Grammar(_TOML, r"[ \t]*")
    return {"java": _java, "go": _go, "rust": _rust, "ruby": _ruby, "shell": _shell, "python": _python}[language]()


def furthest_failure(language: str, text: str) -> int | None:
    """None if the text is valid, else the code point the parser got to. A leading byte order mark
    is skipped; an empty text is valid except as JSON."""
    skip = int(text.startswith("\ufeff"))
    body = text[skip:]
    back = lambda p: p
    if language == "python":
        body, back = _python_lines(body.replace("\r\n", " \n") if "\r" in body else body)
    elif language == "ruby":
        body = _mask_heredocs(body, _HEREDOC, "#")
    elif language == "shell":
        body = _mask_heredocs(body, _SH_HEREDOC, "#")
        if body.startswith("#!"):
            body = "#" + body[1:]
    elif language == "javascript" or language == "typescript":
        if body.startswith("#!"):
            body = "//" + body[2:]
    p = grammar(language).furthest(body)
    return None if p is None else back(p) + skip
