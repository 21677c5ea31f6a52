"""SQL texts of the box and text rules for the oracle side."""


def f(x) -> str:
    """A double literal."""
    return f"{x}::double"


def w(p):
    return f"greatest(1, {p}x2-{p}x1)"


def h(p):
    return f"greatest(1, {p}y2-{p}y1)"


def cx(p):
    return f"(({p}x1+{p}x2)/2)"


def cy(p):
    return f"(({p}y1+{p}y2)/2)"


def sx(a, b):
    return f"greatest(0, least({a}x2,{b}x2)-greatest({a}x1,{b}x1))"


def sy(a, b):
    return f"greatest(0, least({a}y2,{b}y2)-greatest({a}y1,{b}y1))"


def area(p):
    return f"({w(p)}*{h(p)})"


def inter(a, b):
    return f"({sx(a, b)}*{sy(a, b)})"


def smaller_overlap(a, b):
    return f"({inter(a, b)} / least({area(a)},{area(b)}))"


def iou(a, b):
    return f"({inter(a, b)} / greatest(1, {area(a)}+{area(b)}-{inter(a, b)}))"


def hr(a, b):
    return f"(least({h(a)},{h(b)}) / greatest({h(a)},{h(b)}))"


def spatial(a, b):
    ratio = f"({sy(a, b)} / least({h(a)},{h(b)}))"
    d = f"abs({cy(a)}-{cy(b)})"
    tol = f"greatest({f(8)}, ({h(a)}+{h(b)})/2*{f(.35)})"
    reach = f"greatest({f(100)}, (({a}x2-{a}x1)+({b}x2-{b}x1))*{f(.75)})"
    return (
        f"(case when ({ratio} < {f(.5)} and {d} > {tol}) or abs({cx(a)}-{cx(b)}) > {reach} then {f(0)} "
        f"else greatest({f(.05)}, {ratio}, greatest({f(0)}, {f(1)} - {d}/{tol})) end)"
    )


def stream(a, b):
    nw = f"least({w(a)},{w(b)})"
    return (
        f"({hr(a, b)} >= {f(.72)} and abs({cy(a)}-{cy(b)}) <= ({h(a)}+{h(b)})/2*{f(2.5)} "
        f"and abs({cx(a)}-{cx(b)}) <= greatest({f(24)}, {nw}*{f(.25)}) and {sx(a, b)}/{nw} >= {f(.5)})"
    )


def share(a, b):
    return f"({sx(a, b)}/greatest(1, least({a}x2-{a}x1,{b}x2-{b}x1)))"


def stacked(a, b):
    tall = f"greatest({h(a)},{h(b)})"
    d = f"abs({cy(a)}-{cy(b)})"
    return (
        f"({hr(a, b)} >= {f(.72)} and {d} >= {tall}*{f(.52)} and {d} <= {tall}*{f(1.25)} "
        f"and {share(a, b)} >= {f(.6)})"
    )


def substantial(a, b):
    sh = f"least({a}end_time-{a}start_time,{b}end_time-{b}start_time)"
    ov = f"(least({a}end_time,{b}end_time)-greatest({a}start_time,{b}start_time))"
    return f"({sh} > 0 and {ov}/{sh} >= {f(.55)})"


def fold(x):
    return f"replace(lower({x}), 'ß', 'ss')"


def norm_caption(x):
    return f"trim(regexp_replace({fold(f'''replace({x}, '_', ' ')''')}, '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g'))"


def norm_fragment(x):
    return f"trim(regexp_replace({fold(x)}, '[^\\p{{L}}\\p{{N}}_'']+', ' ', 'g'))"


def compact_caption(x):
    return f"regexp_replace({fold(x)}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def norm_eval(x):
    return f"trim(regexp_replace({fold(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def ntok(x):
    return f"(case when {x} = '' then 0 else length({x})-length(replace({x},' ',''))+1 end)"


def run_contained(a, b, strict=True):
    inside = (
        f"case when {ntok(a)} <= {ntok(b)} then contains(' '||{b}||' ', ' '||{a}||' ') "
        f"else contains(' '||{a}||' ', ' '||{b}||' ') end"
    )
    sizes = f"and {ntok(a)} <> {ntok(b)}" if strict else ""
    return f"({ntok(a)} > 0 and {ntok(b)} > 0 {sizes} and {inside})"
