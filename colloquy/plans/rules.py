"""Topic rules as data.

A ``RulePack`` is an ordered list of ``Rule`` rows (first match wins) plus the
auxiliary text predicates of the report: the challenge-mention and engagement
phrases, the auto-reply filter for quotes and the word-cloud stop words.

No match of a pack's patterns may take part of the joint ``' | '`` between two messages but the space right after a message:
``functions/pattern.py`` reads every pattern and guard and refuses those that could, and those that it can't read.
Then every text predicate of a conversation can be
evaluated message by message: matching the messages joined with ``' | '`` is
matching one of them, each but the last followed by the joint's space. Rules
whose matches can end in a space (``joint_rules``) are tested with that space too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.pattern import UnsafePattern, can_end_in_space, check_rule


@dataclass(frozen=True)
class Rule:
    topic: str
    keywords: str  # Java regex alternation, matched case-insensitively
    guard: str | None = None  # negation lookbehind alternation, or None
    word_start: bool = True  # keywords must begin a word
    message_level: bool = True  # also used to classify single messages (quotes)


@dataclass(frozen=True)
class RulePack:
    rules: tuple[Rule, ...]
    default_topic: str
    mention: str  # challenge mention (word-start keywords)
    engage: str  # engagement phrase (word-start keywords)
    quote_exclude: str  # auto-reply filter for quotes (anywhere in the text)
    stop_words: frozenset[str] = field(default_factory=frozenset)
    no_quote_topics: tuple[str, ...] = ()
    word_split: str = "[^a-zà-ÿ]+"
    min_text_len: int = 6  # messages shorter than this are not part of a conversation's text
    quote_min_len: int = 25
    quote_max_len: int = 250

    def __post_init__(self):
        for r in self.rules:
            check_rule(r.keywords, r.guard)
        for p in (self.mention, self.engage):
            check_rule(p)
            if can_end_in_space(p):
                raise UnsafePattern(f"pattern {p!r}: mention and engagement phrases must not end in a space")

    @property
    def joint_rules(self) -> tuple[int, ...]:
        """1-based indexes of the rules whose matches can end in a space."""
        return tuple(i for i, r in enumerate(self.rules, start=1) if can_end_in_space(r.keywords))

    @property
    def topics(self) -> tuple[str, ...]:
        return tuple(r.topic for r in self.rules) + (self.default_topic,)

    @property
    def message_rules(self) -> tuple[Rule, ...]:
        """Rules of the single-message chain (quotes), in pack order."""
        return tuple(r for r in self.rules if r.message_level)

    @property
    def message_chain_is_prefix(self) -> bool:
        """True when the message chain is a leading run of the pack; then a
        message's chain index follows from its full first-match index."""
        k = len(self.message_rules)
        return self.rules[:k] == self.message_rules


# ---------------------------------------------------------------------------
# The report's rule pack, in rule order (first match wins).
# Keywords and guards are regex text; the word-start anchor and the flags are
# added by ``functions.regex.java_regex``.
# ---------------------------------------------------------------------------
NEGATION_GUARD = (
    "n[ãa]o (é |t[áa] |ta |foi |est[áa] |estou |tenho |vou |tem |vai |consegui |deu |sei |quero |sou )?"
    "|nunca |jamais "
)
NEGATION_GUARD_STILL = NEGATION_GUARD + "|ainda n[ãa]o "

RISCO = "cancelar|reembolso|desistir|n[ãa]o quero mais|estornar|me devolv|me arrepend"
TECNICO = (
    "plataforma|hotmart|n[ãa]o consigo acessar|n[ãa]o consegui acessar|ainda n[ãa]o (consigo|consegui) acessar"
    "|n[ãa]o consigo entrar|sem acesso|n[ãa]o recebi (o |meu )?acesso|n[ãa]o abre|n[ãa]o carrega|login|senha"
    "|v[ií]deo n[ãa]o|aula n[ãa]o (abre|carrega)|youtube|aplicativo"
)
DIFICULDADE = (
    "n[ãa]o entendi|t[oô] perdid|tenho d[uú]vida|me ajuda|dif[ií]cil|n[ãa]o sei como|preciso de ajuda|complicado"
    "|n[ãa]o fui avisad|n[ãa]o me avisaram|como funciona (o )?desafio"
    "|como (participo|entro|fa[çc]o pra entrar) (n?o )?desafio"
)
PROVA = (
    "arrematei|consegui arrematar|arrematar meu primeiro|minha primeira arremata|primeira arremata(ç|c)[ãa]o"
    "|ganhei (o |um |meu )?leil[ãa]o|lance vencedor|tive (meu )?primeiro resultado|j[aá] tive resultado"
    "|primeiro resultado com|consegui meu primeiro (im[oó]vel|resultado|lance)"
    "|fechei meu primeiro (neg[oó]cio|im[oó]vel)|recuperei o investimento"
)
ELOGIOS = (
    "amei|adorei|adorando|amando|maravilhos|sensacional|incr[ií]vel"
    "|melhor (curso|conte[uú]do|aula|professor|mentor|investimento|decis[ãa]o)"
    "|gostei (muito|demais|bastante|do|da|de|desse|dessa)|gosto (muito|demais|bastante|do|da|de)"
    "|gostando (muito|demais|do|da|de)|muito bom|t[aá] (sendo )?[óo]tim[oa]|content[ea] (com|demais)"
    "|satisfeit[oa]|recomendo|did[aá]tica (boa|[óo]tim[oa]|excelente|incr[ií]vel|maravilh|sensacional)"
    "|vale a pena|valeu a pena|mudou (a |minha )vida|ajud(ou|ando) (muito|demais|bastante)"
    "|aprendendo (muito|bastante|demais)|conte[uú]do (bom|[óo]timo|rico|incr[ií]vel|excelente|maravilh)"
    "|(curso|aula|m[eé]todo|conte[uú]do) (é |est[áa] |t[áa] |ta |ficou |muito |bem )?"
    "(excelente|[óo]tim[oa]|maravilh|incr[ií]vel|sensacional|rico|top|bom)"
    "|parab[ée]ns|nota (10|dez)|amo (o |as |esse |essa )?(curso|aula|conte|m[eé]todo)|show de bola"
)
ACESSO = (
    "consegui acessar|deu certo (o|os) acesso|deu certo o login|acesso (liberad|funcionou|deu certo|certo|ok)"
    "|j[aá] (acessei|entrei|consegui acessar)|liberaram (o|meu) acesso|recebi (o|meu) acesso"
    "|j[aá] (t[oô]|estou) (dentro|na plataforma|na [aá]rea)|entrei na (plataforma|[aá]rea|conta|aula)"
)
ENGAJAMENTO_CURSO = (
    "assisti|assistindo|comecei|come[çc]ando|j[aá] comecei|estou (assistindo|fazendo|estudando|vendo)"
    "|t[oô] (assistindo|fazendo|estudando)|m[oó]dulo|fiz a (aula|tarefa|atividade)|fazendo os? curso|t[oô] no curso"
)
COMPROMISSO = (
    "vou (fazer|come[çc]ar|tentar|seguir|estudar|assistir|acessar|voltar|maratonar|me dedicar|correr atr[áa]s)"
    "|me comprometo|aceito o desafio|t[oô] dentro|partiu|bora|vamo|maraton|colocar em dia|p[ôo]r em dia"
)
COMUNIDADE = "grupo|telegram|discord|comunidade|whats(app)? do"
AFETIVO = (
    "gratid[ãa]o|aben[çc]oad|obrigad|grat[oa]|familia|filh|m[ãa]e|esposa|marido|sa[uú]de|hospitalizad|viagem"
    "|viajando|ocupad|luto|doente|gr[aá]vid|gestante|cirurgia|internad|faleceu|faleciment"
)
AUTOMATICO = (
    "agradec(e|emos|o)[^|]{0,30}(contato|mensagem)|como (podemos|posso) (te |lhe )?ajud"
    "|em que (posso|podemos) (te |lhe )?ajud|escolha (uma|a |abaixo|uma das|uma op)|seja (muito )?bem.?vind"
    "|corretor[a]? de im[oó]vei|sou (a |o )?[a-zà-ÿ ]{2,28}(corretor|corretora|consultor|consultora|especialista|imobili)"
    "|creci|imobili[áa]ri|despachante|[àa] disposi[çc][ãa]o|estou em atendimento|plant[ãa]o|me informe seu nome"
    "|setor de vendas|central de vendas|financiamento (habitacional|imobili)|loc[aá][çc][ãa]o de im"
    "|especialistas? em|assim que poss[ií]vel[^|]{0,10}(retorn|respond)|em breve[^|]{0,10}(retorno|envio)"
    "|realizando (o|um) sonho|👉|🏡|🏠|🔑"
)
DEFAULT_TOPIC = "outros"

MENCIONA_DESAFIO = "desafio"
ENGAJOU_DESAFIO = "vou (fazer|come[çc]ar|assistir|participar)|t[oô] dentro|topo|aceito|bora|partiu|j[aá] comecei"
QUOTE_AUTO_REPLY = (
    "(agradec(emos|o) (seu|sua) (contato|mensagem))|(n[ãa]o (estamos|estou|estarei) dispon[ií]ve)"
    "|(responderemos|retornarei|retorno em breve|assim que poss[ií]vel)|(deixe sua mensagem)"
    "|(em breve (envio|retorno))|(hor[áa]rio de atendimento)|(seja (muito )?bem.?vindo)"
    "|(sou (corretor|corretora|consultor|consultora|especialista))|(creci)|(setor de vendas)"
    "|(central de vendas)|(plantão)"
)
STOP_WORDS = (
    "para", "pra", "pro", "com", "uma", "não", "nao", "mas", "por", "dos", "das", "como", "mais", "isso", "esse", "essa",
    "são", "sao", "foi", "ser", "tem", "ter", "sua", "seu", "meu", "minha", "minhas", "meus", "suas", "seus", "ele", "ela",
    "eles", "elas", "aqui", "então", "entao", "muito", "muita", "muitos", "muitas", "bem", "ainda", "sim", "num", "numa",
    "nas", "nos", "até", "ate", "depois", "antes", "sobre", "entre", "sem", "quando", "onde", "quem", "qual", "quais",
    "porque", "também", "tambem", "sempre", "nunca", "estava", "estavam", "sendo", "você", "voce", "vcs", "assim", "cada",
    "pois", "desde", "vez", "vezes", "tipo", "nada", "algo", "outro", "outra", "outros", "outras", "mesmo", "mesma", "aquilo",
    "esses", "essas", "aquele", "aquela", "tudo", "todo", "toda", "todos", "todas", "dele", "dela", "deles", "delas", "este",
    "esta", "estes", "estas", "estou", "estamos", "gente", "coisa", "coisas", "bom", "dia", "boa", "tarde", "noite",
    "obrigado", "obrigada", "brigado", "valeu", "beleza", "joia", "ola", "olá", "kkkk", "kkkkk", "kkkkkk", "kkkkkkk",
    "rsrs", "haha", "hahaha", "vamos", "vamo", "agora", "hoje", "ontem", "pode", "posso", "iria", "fica", "ficar", "quero",
    "queria", "acho", "sei", "tava", "nossa", "vai", "vou", "está", "estão", "estao", "tenho", "tinha", "seria", "isto",
    # persona first names of the support team; extend per tenant
    "pamela", "murilo",
)
NO_QUOTE_TOPICS = ("outros", "automatico")

REFERENCE_PACK = RulePack(
    rules=(
        Rule("risco", RISCO, NEGATION_GUARD),
        Rule("tecnico", TECNICO),
        Rule("dificuldade", DIFICULDADE, NEGATION_GUARD),
        Rule("prova", PROVA, NEGATION_GUARD_STILL),
        Rule("elogios", ELOGIOS, NEGATION_GUARD),
        Rule("acesso", ACESSO, NEGATION_GUARD_STILL),
        Rule("engajamento_curso", ENGAJAMENTO_CURSO, NEGATION_GUARD_STILL),
        Rule("compromisso", COMPROMISSO, NEGATION_GUARD),
        Rule("comunidade", COMUNIDADE),
        Rule("afetivo", AFETIVO),
        Rule("automatico", AUTOMATICO, word_start=False, message_level=False),
    ),
    default_topic=DEFAULT_TOPIC,
    mention=MENCIONA_DESAFIO,
    engage=ENGAJOU_DESAFIO,
    quote_exclude=QUOTE_AUTO_REPLY,
    stop_words=frozenset(STOP_WORDS),
    no_quote_topics=NO_QUOTE_TOPICS,
)
