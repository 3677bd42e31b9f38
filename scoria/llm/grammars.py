"""Grammars of the languages whose files are checked (problem 4), over the token classes of scoria.llm.lexer.

P, B and C are the contents of (), [] and {}; i is a name, v a number, string or other literal. Types in angle brackets
have no token; each of a list of them is a TA. Each language has a nonterminal for one item of each kind of list or sequence.
"""

from __future__ import annotations

from scoria.llm.chart import Grammar

EXPRESSION = """
E: U | E Bin U | E ? E : U
Bin: op | pm | * | & | < | > | = | asg
U: Pre U | Post
Post: Prim | Post . i | Post P:Args | Post B:Args | Post inc
"""

JAVA = EXPRESSION + """
Top: package i ; | import static? i Star? ; | TypeD | ;
Star: . *
Mod: mod | default | Ann
Ann: @ i P:Args?
Kind: class | interface | record | @ interface
TypeD: Mod* Kind i P:Params? Ext* C:Body | Mod* enum i Ext* C:Enums
Ext: extends Ts | implements Ts | permits Ts
Ts: T | Ts , T | T & Ts
T: Ann* i Dim*
Dim: B:Empty
Thr: throws Ts
Member: Mod* T i P:Params Dim* Thr? C:Block | Mod* T i P:Params Dim* Thr? ; | Mod* i P:Params Thr? C:Block | Mod* i C:Block | Vars ; | Mod* C:Block | TypeD | ; | Mod* T i P:Empty default E ;
Enum: Consts? ,? ;?
Consts: Const | Consts , Const
Const: Ann* i P:Args? C:Body?
Vars: Mod* T Vs
Vs: V | Vs , V
V: n Dim* | n Dim* = Init
Init: E | C:Inits
Param: Mod* T ...? i Dim* | Mod* T this
Pre: pm | inc | ! | P:Args
Prim: i | v | P:Args | new i P:Args C:Body? | new i Arr+ | new i Arr+ C:Inits | switch P:Args C:Switch | i -> LB | P:Lams -> LB | Prim :: Ref
Arr: B:Args | B:Empty
Ref: i | new
LB: E | C:Block
Lam: Param | i
Arg: E
U: Post instanceof Mod* T i? | Post instanceof Mod* T P
Stmt: Vars ; | SE ; | if P:Args Stmt | if P:Args Stmt else Stmt | for P:For Stmt | while P:Args Stmt | do Stmt while P:Args ; | try P:Res? C:Block Catch* Fin? | switch P:Args C:Switch | return E? ; | throw E ; | break i? ; | continue i? ; | assert E ; | assert E : E ; | i : Stmt | C:Block | TypeD | mod P:Args C:Block | yield E ; | ;
SE: Post = E | Post asg E | inc U | Post inc | Post P:Args | new i P:Args C:Body? | switch P:Args C:Switch
Catch: catch P:CP C:Block
Fin: finally C:Block
CP: Mod* Alts n
Alts: T | Alts op T
For: ForI? ; E? ; Es? | Mod* T i : E
ForI: Vars | Es
Es: E | Es , E
Res: Vars | Res ; Vars | E
Case: case Pats : Stmt* | default : Stmt* | case Pats -> Arm | default -> Arm
Arm: E ; | C:Block | throw E ;
Pats: E | Pats , E | T i
CaseI: Case | Stmt
TA: T | T extends Bounds | Ann* ? | Ann* ? extends Bounds | Ann* ? i T
Bounds: T | Bounds & T
"""

CSHARP = EXPRESSION + """
Top: using static? i ; | using i = i ; | namespace i ; | namespace i C:Top ;? | TypeD | ; | Attr | Stmt
Attr: B:Args
Mod: mod | Attr | new
Kind: class | interface | struct | record | record struct | record class
TypeD: Mod* Kind i P:Params? Base? Where* C:Body ;? | Mod* record i P:Params Base? ; | Mod* enum i Base? C:Names ;? | Mod* delegate T i P:Params ;
Base: : Ts
Ts: T P:Args? | T P:Args? , Ts
Where: where i : Cons
Cons: Con | Cons , Con
Con: T | class | struct | new P:Empty
T: i Q* Dim* | P:Params Q* Dim* | ref T
Q: ?
Dim: B:Empty Q*
Member: Mod* T i P:Params Where* FB | Mod* i P:Params Chain? FB | Mod* Vars ; | Mod* T i C:Props | Mod* T i C:Props = E ; | Mod* T i => E ; | Mod* T this B:Params C:Props | Mod* op i P:Params FB | Mod* T operator AnyOp P:Params FB | Mod* ~ i P:Empty FB | TypeD | ; | Mod* event T i ;
AnyOp: op | pm | * | & | < | > | ! | inc | i
Chain: : i P:Args
FB: C:Block | ; | => E ;
Prop: Mod* i ; | Mod* i C:Block | Mod* i => E ;
Vars: T Vs
Vs: V | Vs , V
V: n | n = Init
Init: E | C:Inits
Param: Attr* mod* T i | Attr* mod* T i = E | this T i | ref T i
Name: i | i = E
Pre: pm | inc | ! | ~ | & | * | P:Args | await | throw
Prim: i | v | P:Args | new NT P:Args C:Inits? | new NT C:Inits | new Arr+ C:Inits? | new NT Arr+ C:Inits? | new C:Inits | new P:Args C:Inits? | i => LB | mod? P:Lams => LB | mod i => LB | B:Args | Prim switch C:Arms | Prim ! | this | default | default P:Args | checked P:Args | stackalloc NT Arr
NT: i Q*
Arr: B:Args | B:Empty
LB: E | C:Block
Lam: Param | i
Arg: E | i : E | ref E | mod E | mod T i | E is E | i | T
U: Post is Not? T i? | Post is Not? E | Post is C | Post as T
Not: not
Post: Post ? . i | Post ?. i | Post ? B:Args
Stmt: Vars ; | mod Vars ; | E ; | if P:Args Stmt | if P:Args Stmt else Stmt | for P:For Stmt | await? foreach P:For Stmt | while P:Args Stmt | do Stmt while P:Args ; | try C:Block Catch* Fin? | switch P:Args C:Switch | return E? ; | return ref E ; | throw E? ; | break ; | continue ; | goto i ; | i : Stmt | C:Block | using P:Res Stmt | await? using Vars ; | lock P:Args Stmt | yield return E ; | yield break ; | mod* T i P:Params FB | ; | mod C:Block | checked C:Block | fixed P:Res Stmt
Catch: catch P:CP? When? C:Block
When: when P:Args
CP: T i?
Fin: finally C:Block
For: ForI? ; E? ; Es? | T i mod E | P:Params mod E
ForI: Vars | Es
Es: E | Es , E
Res: Vars | E
CaseI: Case | Stmt
Case: case E When? : Stmt* | default : Stmt* | case T i When? : Stmt*
ArmE: E => E | E when E => E
TA: Attr* mod? T | Attr* in T
"""

GO = EXPRESSION + """
Top: package i ; | import v ; | import i v ; | import P:Imps ; | Decl ; | ;
Decl: func P:Params? i B:Params? P:Params Res? C:Block | func P:Params? i P:Params Res? | var Spec | const Spec | type TSpec | var P:Specs | const P:Specs | type P:TSpecs
Imp: v | i v | . v
Imps: Imp | Imp ; Imps | Imp ;
Res: T | P:Params
Spec: Ids T? | Ids T? = Es
Specs: Spec | Spec ; Specs | Spec ;
TSpec: i B:Params? = T | i B:Params? T
TSpecs: TSpec | TSpec ; TSpecs | TSpec ;
Ids: i | Ids , i
T: i B:Args? | * T | B:Empty T | B:Args T | map B:Args T | chan T | arrow chan T | chan arrow T | func P:Params Res? | interface C:IBody | struct C:SBody | P:Args
Field: Ids T v? ; | T v? ;
IMem: i P:Params Res? ; | T ; | Un ;
Un: UT | UT op Un
UT: T | ~ T
Param: Ids T | i ... T | T | ... T
Pre: pm | ! | arrow | * | &
Prim: i | v | P:Args | func P:Params Res? C:Block | Lit C:Elems | B:Empty T | B:Args T | map B:Args T | chan T | interface C:IBody | struct C:SBody
Lit: i | B:Empty T | B:Args T | map B:Args T | struct C:SBody
Post: Post C:Elems | Post . P | Post B:Slice
Slice: E? : E? | E? : E? : E?
Elem: E | E : E | C:Elems | E : C:Elems
Arg: E | E ... | T
Es: E | Es , E
Simple: Es | Es asg E | Es = Es | Es := Es | Es := range E | Es = range E | range E | E inc | E arrow E
Stmt: Simple ; | Decl ; | return Es? ; | if Hd C:Block ; | if Hd C:Block Else ; | for Fh? C:Block ; | switch Sh? C:Switch ; | select C:Switch ; | go E ; | defer E ; | break i? ; | continue i? ; | goto i ; | fallthrough ; | i : Stmt? | C:Block ; | ;
Hd: Simple | Simple ; Simple | ; Simple
Else: else if Hd C:Block | else if Hd C:Block Else | else C:Block
Fh: Simple | Simple? ; Simple? ; Simple?
Sh: Simple | Simple ; Simple? | i := E . P
CaseI: Case | Stmt
Case: case Es : Stmt* | default : Stmt* | case Ts : Stmt* | case Simple : Stmt*
Ts: T | Ts , T
"""

RUST = """
E: U | E Bin U | U .. U | U .. | .. U | ..
U: return E | return | break E | break | break Lb E? | continue Lb? | Clo
Lb: lt
Bin: op | pm | * | & | < | > | = | asg | as T Bin
U: Pre U | Post | Post as T
Cond: E | Lets
Lets: Let | E op Let | Lets op Let
Let: let Pat = E
Pre: pm | ! | * | & | & mut | & Lb mut?
Post: Prim | Post . i | Post . v | Post . await | Post P:Args | Post B:Args | Post ? | Post ! P | Post ! B | Post ! C
Prim: i | v | P:Args | B:Args | Block | i C:Inits
Block: C:Block | unsafe C:Block | async move? C:Block | const C:Block | if Cond C:Block Else? | match E C:Arms | loop C:Block | while Cond C:Block | for Pat in E C:Block | Lb : Block
Else: else C:Block | else if Cond C:Block Else?
Clo: move? Bars E | async? move? Bars E | move? Bars -> T C:Block
Bars: op | bars
Arg: E | E ; E | C
Param: Attr* Pat : T | & mut? i | & Lb mut? i | mut? i | i : T | ... | i : ...
Pat: i | mut i | & Pat | & mut Pat | ref mut? i | v | pm v | P:Pats | i P:Pats | i C:FPats | B:Pats | Pat op Pat | Pat .. Pat | .. | Pat .. | i @ Pat | _ | Block
FPat: i | i : Pat | .. | ref? mut? i
T: i | & Lb? mut? T | * const T | * mut T | P:Types | B:Types | dyn Bs | impl Bs | fn P:Types Ret? | ! | unsafe? extern? v? fn P:Types Ret? | i P:Types Ret? | _ | for T
Type: T | T ; E | i : T
Bs: Bnd | Bnd pm Bs
Bnd: T | Lb | ? T | P:Types
Ret: -> T
Attr: # B | # ! B
Vis: pub P?
Wh: where Ws
Ws: Wb | Ws , Wb?
Wb: T : Bs | Lb : Bs
Fn: Vis? Fq* fn i P:Params Ret? Wh? C:Block | Vis? Fq* fn i P:Params Ret? Wh? ;
Fq: const | async | unsafe | extern v? | default
Item: Attr* Item1
Item1: use1 | Fn | Vis? struct i Wh? C:Fields | Vis? struct i P:TFields Wh? ; | Vis? struct i ; | Vis? enum i Wh? C:Variants | Vis? union i C:Fields | unsafe? impl Neg? T Wh? C:Items | unsafe? impl Neg? T for T Wh? C:Items | Vis? unsafe? trait i TB? Wh? C:Items | Vis? type i TB? = T Wh? ; | Vis? type i TB? ; | Vis? const i : T = E ; | Vis? const i : T ; | Vis? static mut? i : T = E ; | Vis? mod i ; | Vis? mod i C:Items | Vis? extern crate i As? ; | unsafe? extern v? C:Items | i ! i? C | i ! P ; | i ! B ; | # ! B | ;
Neg: !
As: as i
TB: : Bs
use1: Vis? use Tree ;
Tree: i | i As | i :: * | i :: C:Trees | :: Tree | * | C:Trees
Field: Attr* Vis? i : T
TField: Attr* Vis? T
Variant: Attr* i | Attr* i P:TFields | Attr* i C:Fields | Attr* i = E
Init: Attr* i : E | i | .. E | v : E
Stmt: Item | let1 ; | E ; | Attr* Block | Attr* let1 ; | Attr* E ; | i ! C
let1: let Pat LT? | let Pat LT? = E | let Pat LT? = E else C:Block
LT: : T
Tail: Stmt* E?
Head: Attr* op? Pat Guard? =>
Arm: Head E , | Head Block
LastArm: Arm* | Arm* Head E
Guard: if Cond
TA: lt | lt : Bs | T | i : Bs | i : | i : Bs = T | i = T | v | pm v | Block | const i : T | const i : T = Arg
"""

SCRIPT = EXPRESSION + """
Item: import v ; | import Clause from v ; | export Decl | export default Decl | export default E ; | export * from v ; | export * as i from v ; | export C:Specs ; | export C:Specs from v ; | Stmt
Clause: i | C:Specs | * as i | i , C:Specs | i , * as i | type C:Specs | type i
Spec: i | i as i | default as i | i as default | type i | v as i
Decl: Fn | Class | Vars ;
Fn: async? function *? i? P:Params Ret? C:Block
Class: Deco* class i? Heri? C:Body
Heri: extends Post
Deco: @ i P:Args?
Vars: VK Vs
VK: var | let | const
Vs: V | Vs , V
V: Bind | Bind = E
Bind: i | C:Binds | B:Binds
BindE: Bind | Bind = E | ... Bind | i : Bind | i : Bind = E | v : Bind | B:Args : Bind
Param: Bind | Bind = E | ... Bind
Pre: pm | inc | ! | ~ | await | typeof | void | delete | yield | yield *
Prim: i | v | this | super | P:Args | B:Args | B:Empty | C:Props | Fn | Class | new New | i => LB | async i => LB | P:Params => LB | async P:Params => LB | import P:Args | import . i | Post v | async
New: Post | new New | . i
LB: E | C:Block
Post: Post ?. i | Post ?. P:Args | Post ?. B:Args | Post . kw | C:Props
U: yield | Post op in E
Bin: in | instanceof | of
Arg: E | ... E
Prop: i | K : E | ... E | MKs* K P:Params Ret? C:Block | MKs* * K P:Params Ret? C:Block | i = E
K: i | v | B:Args | kw | this | default
MKs: get | set | async | static
Member: Deco* MKs* *? K P:Params Ret? C:Block ;? | Deco* MKs* K ; | Deco* MKs* K = E ; | static C:Block | ;
Es: E | Es , E
Stmt: Es ; | Vars ; | Fn | Class | if P:Args Stmt | if P:Args Stmt else Stmt | for await? P:For Stmt | while P:Args Stmt | do Stmt while P:Args ;? | try C:Block Catch? Fin? | switch P:Args C:Switch | return Es? ; | throw E ; | break i? ; | continue i? ; | i : Stmt | C:Block | debugger ; | with P:Args Stmt | ;
Catch: catch P:Params? C:Block
Fin: finally C:Block
For: ForI? ; Es? ; Es? | VK Bind of E | VK Bind in E | Post of E | Post in E
ForI: Vars | Es
CaseI: Case | Stmt
Case: case Es : Stmt* | default : Stmt*
"""
#: A script has no types; the nonterminal is there but nothing matches it.
JAVASCRIPT = SCRIPT + "Ret: untyped untyped\n"
TYPESCRIPT = SCRIPT + """
Ret: : RT
RT: T | i is T | asserts i | asserts i is T
T: T1 | T1 op T | T1 & T | op T | & T | T1 extends T ? T : T | P:Params => T | mod? new P:Params => T | i is T
T1: i | v | this | void | pm v | typeof i | P:Types | B:Types | C:Members | T1 B:Empty | T1 B:Types | keyof T1 | readonly T1 | infer i | infer i extends T1 | unique i | import P:Args | import P:Args . i
Type: T | ... T | i : T | i Opt : T | i ?
Opt: ?
VT: : T
V: Bind Bang? VT | Bind VT = E
Bang: !
MKs: mod | declare | readonly
Class: MKs+ class i Heri? Imp? C:Body | Deco* class i? Heri? Imp C:Body
Imp: implements Ts
Ts: T | Ts , T
TA: TV* T | TV* i extends T | TV* i extends T = T | TV* i = T
TV: const | in
Param: MP* Bind Opt? VT | MP* Bind VT = E | MP* Bind Opt | ... Bind VT | this VT | MP+ Bind
MP: mod | readonly | Deco
Decl: TD
TD: interface i IExt? C:Members | type i = T ; | declare? const? enum i C:Enums | declare? namespace i C:Block | declare module v C:Block | declare Fn ; | declare Vars ; | declare Class | MKs* function i P:Params Ret? ; | namespace i C:Block
IExt: extends Ts
EnumM: i | i = E | v | v = E
Member: Deco* MKs* *? K Opt? P:Params Ret? ; | Deco* MKs* *? K Opt? P:Params Ret? C:Block | Deco* MKs* K Opt? VT ; | Deco* MKs* K Bang? VT ; | Deco* MKs* K VT = E ; | MKs* B:Params VT ; | Deco* MKs* K Opt ;
MemI: Mem ; | Mem , | ;
Mem: MKs* K Opt? VT | MKs* K Opt? P:Params Ret? | P:Params Ret | new P:Params Ret | MKs* B:Params Opt? VT | K Opt? | MKs* pm? B:In pm? Opt? VT
In: i in T | i in T as T
Stmt: TD | Fn ;
Fn: async? function *? i? P:Params Ret? ;
U: U as T | U as const | U satisfies T | U !
Post: Post !
Prim: P:Params Ret => LB | async P:Params Ret => LB
Catch: catch P:Params C:Block
Item: export TD | export = E ; | import i = E ; | export type C:Specs ; | export type C:Specs from v ; | export declare Decl | export default interface i C:Members
"""

PYTHON = """
E: O | O if O else E | lambda LPs? : E | i := E | await E
O: U | O Bin U
Bin: op | pm | * | & | < | > | in | not in | is | is not | and | or
U: Pre U | Post
Pre: pm | ~ | not | await
Post: Prim | Post . i | Post P:Args | Post P:Gen | Post P:Empty | Post B:Subs
Prim: i | v | Vs | P:Tuple | P:Gen | P:Empty | B:List | B:Gen | B:Empty | C:Dict | C:Gen | C:DGen | C:Empty | ...
Vs: v v | v Vs
Arg: E | * E | ** E | i = E | E Comp+
Item: E | * E | yield Es? | yield from E
Gen: E Comp+
DGen: E : E Comp+
Comp: async? for Tg in O Cond*
Cond: if O
Sub: E | E? : E? | E? : E? : E? | * E
KV: E : E | ** E | E | * E
Es: Ss | Ss ,
Ss: SE | Ss , SE
SE: E | * E
Tg: Tgs | Tgs ,
Tgs: TgE | Tgs , TgE
TgE: Post | * Post
LPs: LP | LP , | LP , LPs
LP: i | i = E | * i | ** i | * | /
Param: i An? | i An? = E | * i An? | ** i An? | * | /
An: : E | : * E
Line: Simple | Simple ; | Simple ; Line | Head | Head Simple | @ E
Head: async? def i B? P:Params Ret? : | class i B? P:Args? : | class i B? P:Empty : | async? for Tg in Es : | while E : | if E : | elif E : | else : | try : | except Ex? : | except * Ex : | finally : | async? with Ws : | match Es : | case Cs :
Ret: -> E
Ex: E | E as i | Es
Ws: W | Ws , W | P:Withs
W: E | E as TgE
Cs: C1 | C1 if E | Es | Es as i | Es if E
C1: O as i | O
Simple: Es | Es An2 | Tg asg Es | Tg asg yield Es? | Asgn | pass | break | continue | return Es? | raise | raise E | raise E from E | global Ids | nonlocal Ids | del Es | assert E | assert E , E | import Mods | from Dots? i import Names | from Dots import Names | yield Es? | yield from E | type i B? = E
An2: : E | : E = Es | : E = yield Es?
Asgn: Tg = Asgn | Tg = Es | Tg = yield Es? | Tg = yield from E
Ids: i | Ids , i
Mods: Mo | Mods , Mo
Mo: i | i as i
Dots: . | ... | . Dots | ... Dots
Names: * | Mods | P:Names
"""

JSON = """
V: v | C:Pairs | B:Values | C:Empty | B:Empty
Pair: s : V
Top: V
V: s | pm v
"""

GRAMMARS = {"java": JAVA, "csharp": CSHARP, "go": GO, "rust": RUST, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "python": PYTHON, "json": JSON}
_built: dict[str, Grammar] = {}


def grammar(language: str) -> Grammar:
    if language not in _built:
        _built[language] = Grammar(GRAMMARS[language])
        for _, item in SEQUENCES[language]:
            _built[language].sequence(item)
        _built[language].sequence(TOPS[language])
    return _built[language]


#: Labels of bracket contents. Lists: (label, item's nonterminal, separator); sequences: (label, item's nonterminal);
#: wholes: a nonterminal for all of the contents.
LISTS = {
    "java": {"P": [("Args", "Arg"), ("Params", "Param"), ("Lams", "Lam")], "B": [("Args", "Arg")], "C": [("Inits", "Init")]},
    "csharp": {"P": [("Args", "Arg"), ("Params", "Param"), ("Lams", "Lam")], "B": [("Args", "Arg"), ("Params", "Param")], "C": [("Inits", "Init"), ("Names", "Name"), ("Arms", "ArmE")]},
    "go": {"P": [("Args", "Arg"), ("Params", "Param")], "B": [("Args", "Arg"), ("Params", "Param")], "C": [("Elems", "Elem")]},
    "rust": {"P": [("Args", "Arg"), ("Params", "Param"), ("Types", "Type"), ("Pats", "Pat"), ("TFields", "TField")], "B": [("Args", "Arg"), ("Types", "Type"), ("Pats", "Pat")], "C": [("Inits", "Init"), ("FPats", "FPat"), ("Fields", "Field"), ("Variants", "Variant"), ("Trees", "Tree")]},
    "javascript": {"P": [("Args", "Arg"), ("Params", "Param")], "B": [("Args", "Arg"), ("Binds", "BindE")], "C": [("Props", "Prop"), ("Binds", "BindE"), ("Specs", "Spec")]},
    "python": {"P": [("Args", "Arg"), ("Params", "Param"), ("Tuple", "Item"), ("Names", "Mo"), ("Withs", "W")], "B": [("Subs", "Sub"), ("List", "Item")], "C": [("Dict", "KV")]},
    "json": {"C": [("Pairs", "Pair")], "B": [("Values", "V")]},
}
LISTS["typescript"] = {"P": [*LISTS["javascript"]["P"], ("Types", "Type")], "B": [*LISTS["javascript"]["B"], ("Types", "Type"), ("Params", "Param")], "C": [*LISTS["javascript"]["C"], ("Enums", "EnumM")]}
WHOLES = {
    "java": {"P": ["For", "Res", "CP"]}, "csharp": {"P": ["For", "Res", "CP"]}, "go": {"P": ["Imps", "Specs", "TSpecs"], "B": ["Slice"]}, "rust": {},
    "javascript": {"P": ["For"]}, "typescript": {"P": ["For"], "B": ["In"]}, "python": {"P": ["Gen"], "B": ["Gen"], "C": ["Gen", "DGen"]}, "json": {},
}
#: Wholes that are items with semicolons between them, which are matched item by item.
SEMICOLON_LISTS = {"go": {"Imps": "Imp", "Specs": "Spec", "TSpecs": "TSpec"}}
SEQUENCES = {
    "java": [("Block", "Stmt"), ("Body", "Member"), ("Switch", "CaseI"), ("Enums", "Member")],
    "csharp": [("Block", "Stmt"), ("Body", "Member"), ("Switch", "CaseI"), ("Props", "Prop"), ("Top", "Top")],
    "go": [("Block", "Stmt"), ("Switch", "CaseI"), ("SBody", "Field"), ("IBody", "IMem")],
    "rust": [("Block", "Stmt"), ("Items", "Item"), ("Arms", "Arm")],
    "javascript": [("Block", "Stmt"), ("Body", "Member"), ("Switch", "CaseI")],
    "typescript": [("Block", "Item"), ("Body", "Member"), ("Switch", "CaseI"), ("Members", "MemI")],
    "python": [], "json": [],
}
#: The first and the last stretch of a sequence where they may be other things than those between.
FIRST_ITEMS = {"java": {"Enums": "Enum"}}
LAST_ITEMS = {"rust": {"Block": "Tail", "Arms": "LastArm"}}
TOPS = {"java": "Top", "csharp": "Top", "go": "Top", "rust": "Item", "javascript": "Item", "typescript": "Item", "python": "Line", "json": "Top"}
