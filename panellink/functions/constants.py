"""Word lists, tables, weights and thresholds that results depend on."""

from __future__ import annotations

# --- fixed values: linkage -----------------------------------------------------------------------------------

#: Weight of each feature, in the order in which contributions are added.
DEFAULT_WEIGHTS = {"last_name": 6.0, "first_name": 5.0, "middle_name": 1.5, "suffix": 3.0, "salutation": 1.0, "gender": 2.0, "title_standard": 0.5}
LINK_THRESHOLD = 7.0
PROB_THRESHOLD = 0.5
MAX_BLOCK_SIZE = 5000

#: Blocking passes from the tightest to the loosest, with the parts of their keys.
BLOCKING_PASSES = {"strict": ("last", "state", "ntee"), "metro": ("last", "cbsa", "ntee"), "geo": ("last", "ntee"), "industry": ("last", "state"), "surname": ("last",)}

# --- fixed values: names --------------------------------------------------------------------------------------

SURNAME_PARTICLES = (
    "AL BIN DA DE DEL DELA DELLA DER DES DI DO DOS DU EL IBN LA LE LO MAC MC SAN SANTA ST STE TER VAN VANDE VANDER VON Y"
).split()

#: Canonical given names and their nicknames.
NICKNAMES = """
ROBERT BOB BOBBY ROB ROBBIE BERT
WILLIAM BILL BILLY WILL WILLIE LIAM
RICHARD DICK RICH RICK RICKY RICHIE
JOHN JACK JOHNNY JON
JAMES JIM JIMMY JAMIE
ELIZABETH LIZ LIZZY BETH BETSY ELIZA LISA LIBBY ELLIE
MARGARET MEG PEGGY MAGGIE MARGE GRETA MADGE
KATHERINE KATE KATIE KATHY KAT KITTY
CATHERINE CATHY KATE KATIE CATE
CHARLES CHARLIE CHUCK CHAS
THOMAS TOM TOMMY
MICHAEL MIKE MICKEY MICK
EDWARD ED EDDIE TED NED
ANTHONY TONY
JOSEPH JOE JOEY
DANIEL DAN DANNY
DAVID DAVE DAVEY
MATTHEW MATT
ANDREW ANDY DREW
NICHOLAS NICK NICKY
PATRICIA PAT PATTY TRICIA
PATRICK PAT PADDY
SUSAN SUE SUZY SUSIE
JENNIFER JEN JENNY
DEBORAH DEB DEBBIE
BARBARA BARB BABS
CHRISTOPHER CHRIS TOPHER
STEPHEN STEVE STEVIE
STEVEN STEVE STEVIE
KENNETH KEN KENNY
RONALD RON RONNIE
DONALD DON DONNIE
GERALD GERRY JERRY
SAMUEL SAM SAMMY
BENJAMIN BEN BENNY
ALEXANDER ALEX AL SANDY
GREGORY GREG
TIMOTHY TIM TIMMY
FREDERICK FRED FREDDIE
THEODORE TED THEO
VIRGINIA GINNY GINGER
VICTORIA VICKY TORI
REBECCA BECKY BECCA
CYNTHIA CINDY
DOROTHY DOT DOTTIE DORA
ELEANOR ELLIE NELL NORA
FRANCIS FRANK FRANKIE
FRANCES FRAN FRANNIE
LAWRENCE LARRY
LEONARD LEN LENNY
PHILIP PHIL
PHILLIP PHIL
RAYMOND RAY
WALTER WALT
HENRY HANK HARRY
ALBERT AL BERT
HAROLD HAL HARRY
EUGENE GENE
VINCENT VINCE VINNIE
ARTHUR ART ARTIE
JOSHUA JOSH
ZACHARY ZACH ZAC
NATHANIEL NATE NAT
JONATHAN JON JONNY
ABIGAIL ABBY ABBIE
AMANDA MANDY
MELISSA MISSY
SANDRA SANDY
PAMELA PAM
PENELOPE PENNY
"""

HONORIFICS = "MR MRS MS MISS DR REV HON PROF FR SR SISTER RABBI PASTOR FATHER SIR DAME".split()
CREDENTIALS = (
    "RT RN MD DDS DMD PHD PHARMD CAE RDMS RVT RM RMSBS MSM MSRS CRA CNMT MBA ESQ CPA JD LCSW MSW MPH MHA FACHE FASRT CFRE RTR RRT FNP APRN AIA EDD"
).split()
CORPORATE_TOKENS = (
    "INC LLC LLP LP CORP CORPORATION COMPANY CO BANK BANCORP TRUST GROUP ASSOC ASSOCIATES ASSOCIATION FOUNDATION UNIVERSITY COLLEGE INSTITUTE LTD PLLC PC "
    "SERVICES SYSTEM SYSTEMS CENTER CENTRE SOCIETY PARTNERS PARTNERSHIP CAPITAL REALTY PROPERTIES CHURCH SCHOOL HOSPITAL CLINIC FUND MANAGEMENT CONSULTING "
    "ADVISORS INSURANCE ENTERPRISES INDUSTRIES HOLDINGS CPA CPAS AGENCY BUREAU COUNCIL COMMISSION DEPARTMENT DISTRICT"
).split()
PLACEHOLDER_NAMES = (
    "BLANK|NONE|N/A|NA|NONE.|SAME|VACANT|TBD|UNKNOWN|SEE ATTACHED|SEE SCHEDULE O|SEE SCH O|SEE STATEMENT|VARIOUS|X|XX|XXX|-|--|---|*|."
).split("|")
GENERATIONS = "JR SR I II III IV V".split()

# --- fixed values: titles -------------------------------------------------------------------------------------

ROLES = ("BOARD", "OFFICER", "STAFF", "OTHER")
ROLE_RANKS = {"OFFICER": 3, "STAFF": 2, "OTHER": 1}
#: Titles that are a governance seat by themselves.
GOVERNANCE_BASES = (
    "PRESIDENT|VICE PRESIDENT|VP|SECRETARY|TREASURER|SECRETARY-TREASURER|SECRETARY/TREASURER|SECRETARY TREASURER|CHAIR|CHAIRMAN|CHAIRPERSON|CHAIRWOMAN|"
    "CHAIRMAN OF THE BOARD|DIRECTOR|TRUSTEE|MEMBER|BOARD MEMBER|BOARD|PRESIDENT-ELECT|PRESIDENT ELECT|GOVERNOR|REGENT|OVERSEER|ELDER|DEACON|COMMISSIONER"
)
#: Words that may stand before them, any number of times.
GOVERNANCE_MODIFIERS = (
    "VICE|CO|FIRST|SECOND|THIRD|FOURTH|1ST|2ND|3RD|4TH|SR|JR|SENIOR|JUNIOR|ASSISTANT|ASST|ASSOCIATE|ASSOC|DEPUTY|PAST|IMMEDIATE PAST|INCOMING|OUTGOING|"
    "ACTING|INTERIM|HONORARY|EMERITUS|EX OFFICIO|BOARD"
)
OFFICER_PATTERN = (
    r"^C[A-Z]?[EFOAITDMR]O$|CHIEF .*OFFICER|EXECUTIVE DIRECTOR|EXECUTIVE VICE PRESIDENT|GENERAL MANAGER|MANAGING DIRECTOR|GENERAL COUNSEL|COMPTROLLER|CONTROLLER|"
    r"PRESIDENT (AND|&|/) ?(CEO|C\.E\.O)"
)
STAFF_PATTERN = (
    " OF |DIRECTOR$|DIRECTOR |MANAGER|COORDINATOR|ADMINISTRATOR|SUPERVISOR|CLERK|EMPLOYEE|^STAFF$|ASSISTANT|WEBMASTER|ANALYST|SPECIALIST|OFFICER|ADVISOR"
)

# --- fixed values: review -------------------------------------------------------------------------------------

LINK_CATEGORIES = ("review", "surname_credential", "order_swap", "parser_honorific_glue", "surname_compound", "nickname_or_spelling")
ANOMALY_CATEGORIES = (
    "invariant_violation", "entity_not_person", "duplicate_line", "homonym_copresent", "sequential_homonym_pay", "sequential_homonym_gap",
    "intermittent", "org_field_name", "name_shape",
)
MERGE_WEIGHTS = {"dup_id_in_year": 5.0, "id_spans_orgs": 5.0, "homonym_copresent": 3.0, "gap_pay_shift": 2.5, "gap_return": 2.0, "gap_long": 1.5, "sporadic": 1.0}


def nickname_table() -> dict[str, list[str]]:
    """Canonical given name to its nicknames."""
    return {w[0]: w[1:] for w in map(str.split, NICKNAMES.strip().splitlines())}


def name_roots() -> dict[str, list[str]]:
    """Every name of the table to the sorted canonicals it stands for."""
    roots: dict[str, set[str]] = {}
    for canonical, variants in nickname_table().items():
        for name in (canonical, *variants):
            roots.setdefault(name, set()).add(canonical)
    return {name: sorted(r) for name, r in roots.items()}


def known_first_names() -> list[str]:
    return sorted(name_roots())
