"""Labelled paragraphs for the redaction model, made from templates and invented names.

A template has slots {P} person, {G} given name, {S} surname, {E} email, {N} phone, {I} identity number,
{A} address, {Z} {J} {H} {B} {K} a Chinese, Japanese, Hindi, Arabic or Thai person, {ZA} {JA} addresses and, for what
must not be redacted, {num}, {w} (lower-case words), {W} (German nouns), {T} (titled things), {C} (places) and codes.
The sentences were written for the model; none is taken from a table that it is run on."""

from __future__ import annotations

import random
import re

from . import pii_lexicon as L

ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sch sh st t th tr v w z".split()
VOWELS = "a e i o u ai ea ie oo ou".split()
CODAS = "n r l s t ck ng nd rd m rt x th ll".split()
ENDS = "son ton ley man berg er ez in ard et ski sen well ford ham a o i mann stein".split()
TOWNS = "Ashbourne Kirkwell Dunmore Lakefield Bergheim Waldau Steinfurt Villeneuve Montclar Beauvoir Almedina Vallehermoso Southwick Marlow Oberdorf Saint-Cyr Villanueva".split()
WORDS = """boiler sofa parcel garden bicycle lecture concert recipe kettle ladder window tenancy violin laptop keyboard mattress ticket
voyage repas jardin vélo clavier colis bail viaje jardín bicicleta teclado cena alquiler recibo""".split()
NOUNS = "Kessel Garten Paket Fahrrad Vortrag Rezept Leiter Fenster Mietvertrag Tastatur Reise Konzert Kündigung Lieferung Werkstatt Heizung Wohnung Termin Schlüssel Angebot Versicherung Buchung Bestellung Zahlung".split()
THINGS = "Orchard Jupiter Falcon Summit Cedar Aurora Beacon Maple Granite Cobalt Horizon Lotus".split()
KINDS_OF = "Suite Platform Project Initiative Programme Museum Theatre Railway Airport Insurance Holdings Partners Festival Awards Conference University".split()

TEMPLATES = [
    # English: people
    "My landlord {P} fixed the {w} last night.", "We bought the {w} from {P} in {num}.", "The nurse, {P}, brought a {w}.", "Could you tell {P}?", "{P} never returned our {w}.",
    "It was {P} who painted the {w}.", "A letter for {P} arrived yesterday.", "Before lunch {P} and {P} argued over a {w}.", "Our neighbours {P}, {P} and {P} share one {w}.", "Mr {S} teaches the violin.",
    "Mrs. {S} borrowed a {w} from Dr. {P}.", "Ms {P} bakes bread; Prof. {S} eats it.", "Dear {G},\nthe {w} has arrived.", "Hey {G}! Lunch at noon?", "Best wishes,\n{P}", "Kind regards\n{G}\n{P}\n{N}",
    "{P}'s bicycle was stolen.", "I spoke with {G} about dinner.", "{G} and {G} went home early.", "the dentist {P} closed her practice", "She married {P} in June.", "Guests: {P}, {P}, {G} {S}", "Interview with {P} ({num})",
    "photo by {P}", "Painter {P} sold the {w} to gallery owner {P}.", "Senior Product Designer {P} resigned.", "Head Gardener {P} trims the hedge.", "Thank you, {P}, for the lovely {w}.", "Witness statement of {P}:",
    "According to neighbour {P}, nobody was home.", "The winner is {P}!", "Minutes taken by {P}. Present were {P} and {G}.", "\"No,\" replied {P}, \"not today.\"", "In the end {P} sold everything.", "Yesterday {P} phoned twice.", "{P} | {N} | {E}", "{P}\t{E}\t{N}", "{P};{N};{A}", "- {P}: {N}", "* {P} <{E}>", "| {P} | {E} |", "{P}, {A}", "Patient: {P}, born 4/12/19{num}, insurance {I}",
    "{P}, whose {w} leaks, called again.", "Give the {w} to {G} or to {S}.", "CC: {P}; {P}", "Reviewed-by: {P} <{E}>", "The parcel came back because {P} had left.", "Tenants {P} and {P} pay by transfer.", "Report written by {P} of {T}.", "Staff: {P}, {P}, {P}, {P}, {P}",
    "Tell {P} or text {N}.", "Invite {P} and {P}.", "Contact {P} ({E}).", "Meet {P} at noon.", "Thank {P} ({N}) for the {w}.", "Visit {P}, {A}.", "Remind {P} ({E}) again.",
    # English: other kinds
    "You can reach me at {N} or {E}.", "Telephone {N} between nine and five.", "Text {N} to unsubscribe.", "Her mobile is {N}, office {N}.", "Write to {E} for tickets.", "Email: {E}\nPhone: {N}", "Fax {N}.", "Ring us on {N}!", "Mail your forms to {A}.", "He moved to {A} in spring.", "We live at {A}, near the river.", "The bakery stands at {A}.",
    "Home: {A}", "Her social security number is {I}.", "SSN: {I}", "National insurance number {I} belongs to {P}.", "Passport or ID {I} was lost.", "Tax ID {I}", "His number, {I}, was printed on the card.", "the card shows identity no. {I}",
    # English: nothing to redact
    "The {w} and the {w} cost {num} crowns.", "{T} opens its doors in {C}.", "{T} and {T} merged last year.", "Visit {C} or {C} in summer.", "In {C}, trains leave every {num} minutes.", "New in version {ver}: faster {w}.", "Parcel {long} left the depot.", "Tracking code {long}.", "Order {long} ships on Monday.", "Serial {part} is printed below.",
    "Lot {build} expired.", "Rows {range} are empty.", "Invoice no. {long}, due in May.", "Meter reading {long}.", "Chapter {num}: Advanced Cooking Techniques", "## Summer Reading List", "# How To Clean Your {w}", "The Senior Gardener and the Head Cook disagree.", "Our Board of Trustees met the City Council.", "Terms And Conditions Apply", "Please Mind The Gap", "Happy Birthday! Good Morning! Thank You!",
    "The Prime Minister spoke to Parliament on Friday.", "Red Cross volunteers met at Central Park in New York.", "Will the {w} last? Mark my words.", "I hope so. Faith moves mountains, grace and joy too.", "Use Microsoft Excel, Adobe Reader or Google Chrome.", "HTTP Error {num}: Bad Gateway at Load Balancer", "Run `make install` with port {num}.", "IBAN and BIC are on page {num}.", "See Figure {num} and Table {num}.",
    "Monday Tuesday Wednesday", "Customer Service, Human Resources, Public Relations", "Dear customer, dear colleagues, dear all,", "Dear Sir or Madam,", "Hello world, hello again.", "Hi there!", "The score was {range} after {num} games.", "Room {range}, floor {num}", "1984-2003: The Lost Years", "Phone us any day.", "{T} Annual Dinner", "The Big Apple Circus returns.", "They sent {long} units to {C}.", "{T} Ltd. hired ten people.",
    # German
    "Gestern hat {P} den {W} verkauft.", "Unser Vermieter {P} repariert die {W}.", "Die Ärztin {P} kommt später.", "Frau {S} und Herr {S} streiten über die {W}.", "Herr Dr. {P} ist verreist.", "Lieber {G},\nder {W} ist da.", "Hallo {G}! Wie geht es dir?", "Mit freundlichen Grüßen\n{P}", "Viele Grüße, {G}", "Der Mieter {P} zog aus.", "Die Kundin {P} wartet auf die {W}.",
    "Das {W} gehört {P}.", "Von {P} stammt das {W}.", "{P} sagte, die {W} sei kaputt.", "Ansprechpartnerin ist {P}, Durchwahl {N}.", "Nach Angaben von {P} fehlt ein {W}.", "{P} und {P} heiraten im Mai.", "Frau Prof. {P} hält den {W}.", "Ich traf {P} in {C}.", "Name: {P}, Anschrift: {A}", "Meine Nummer ist {N}.", "Telefon {N}, Fax {N}", "Mail an {E} genügt.", "Wir wohnen {A}.", "Sie finden uns in der {A}.", "Die Werkstatt liegt {A}.", "Personalausweis {I}", "Sozialversicherungsnummer {I} von {P}", "Ihre Steuer-ID lautet {I}.", "Schreiben Sie {P} einen Brief.", "Kollegin {P} springt ein.",
    "Fragen Sie {P}.", "Informiert {P} ({N}).", "Grüßt {P}!", "Die {W} und der {W} kosten {num} Euro.", "Der {W} für die {W} liegt im Keller.", "Im Garten steht ein Fahrrad neben der Leiter.", "Am Montag beginnt die Arbeit an der {W}.", "Die Deutsche Bahn fährt nach {C}.", "Das Rote Kreuz sammelt Kleidung.", "Zum Thema Wohnung: siehe Kapitel {num}.", "Das Amt für Soziales schließt um {num} Uhr.", "Bestellung {long} wurde versandt.", "Die Frist für Zahlung und Lieferung endet.", "Guten Morgen zusammen, der {W} ist neu.", "Hinweis: {W} prüfen, {W} leeren.", "Welche Kosten trägt der Mieter? Keine Angaben.", "Die Stadtwerke {C} melden eine Störung.", "Sehr geehrte Damen und Herren,", "Technische Daten der {W}: Höhe {num}", "Jede {W} braucht neuen Strom, Wasser und Luft.",
    # French
    "Hier soir {P} a vendu son {w}.", "Notre voisine {P} arrose le {w}.", "M. {S} et Mme {S} sont partis.", "Monsieur {P} répare le {w}.", "Le médecin {P} est absent.", "Cher {G},\nle {w} est arrivé.", "Salut {G} !", "Bien à vous,\n{P}", "C'est {P} qui a perdu le {w}.", "La cliente {P} attend.", "D'après {P}, il pleuvra.", "{P} et {P} se marient.", "Mlle {S} joue du piano.", "Photo : {P}", "le peintre {P} expose à {C}", "J'ai rencontré {P} à {C}.",
    "Prévenez {P} ({E}).", "Invitez {P} !", "Mon numéro est le {N}.", "Tél. {N}", "Écrivez à {E} avant lundi.", "Nous habitons {A}.", "Domicile : {A}", "Le café se trouve {A}.", "Carte d'identité {I}", "NIR : {I}", "{P} porte le numéro fiscal {I}.",
    "Le {w} et le {w} coûtent {num} euros.", "La Croix-Rouge recrute à {C}.", "Le Conseil municipal vote le budget.", "Commande {long} expédiée.", "Voir la page {num}, rubrique Jardin.", "Mesdames, Messieurs,", "Bonjour à tous, le {w} est neuf.", "La Direction générale ferme lundi.", "Les Jeux Olympiques arrivent à {C}.", "Le Musée des Arts et le Théâtre National rouvrent.",
    # Spanish
    "Anoche {P} vendió su {w}.", "Nuestra vecina {P} riega el {w}.", "El Sr. {S} y la Sra. {S} salieron.", "Doña {P} cocina bien.", "El médico {P} no está.", "Querida {G}:\nllegó el {w}.", "¡Hola {G}!", "Un saludo,\n{P}", "Fue {P} quien perdió el {w}.", "La clienta {P} espera.", "{P} y {P} se casan en mayo.", "Foto de {P}", "el pintor {P} expone en {C}", "Conocí a {P} en {C}.", "El Dr. {P} opera mañana.",
    "Invite a {P}.", "Visite a {P} ({E}).", "Mi número es el {N}.", "Móvil: {N}", "Escriba a {E} antes del lunes.", "Vivimos en {A}.", "Domicilio: {A}", "El bar está en {A}.", "DNI: {I}", "{P} perdió su NIE {I}.", "con documento de identidad {I}",
    "El {w} y la cena cuestan {num} euros.", "La Cruz Roja busca voluntarios en {C}.", "El Ayuntamiento aprobó el presupuesto.", "Pedido {long} enviado.", "Véase la página {num} del Anexo.", "Estimados señores:", "Buenos días a todos, el {w} es nuevo.", "La Dirección General cierra el lunes.", "El Museo del Prado y el Teatro Real abren.",
    # Chinese
    "昨天{Z}来过。", "{Z}先生喜欢喝茶。", "请{Z}女士到前台。", "医生{Z}今天休息。", "我和{Z}一起吃饭。", "{Z}说下雨了。", "会议主持人：{Z}", "参会人员：{Z}、{Z}、{Z}。", "{Z}，手机{N}", "姓名：{Z}，电话：{N}", "收件人{Z}，地址{ZA}。", "房东{Z}把钥匙交给了{Z}。", "感谢{Z}的帮助。", "这幅画由{Z}完成。", "作者：{Z}", "{Z}负责做饭，{Z}负责洗碗。", "老师{Z}住在{ZA}。", "{Z}\t{N}\t{E}", "{Z} | {E}", "{Z}的身份证号码是{I}。", "证件号{I}", "拨打{N}订餐。", "写信到{E}即可。", "快递寄到{ZA}。", "我家在{ZA}，欢迎来玩。", "公司总经理{Z}宣布放假。", "据{Z}介绍，", "由{Z}记录，{Z}审核。", "小区住户{Z}投诉。",
    "高铁每{num}分钟一班。", "方法很多，程序复杂，任务繁重。", "周一至周五开放，周末休息。", "文件已经保存，时间是{num}点。", "黄色的花和白色的云。", "万一下雨，马上回家。", "张贴海报需要许可。", "常见问题与高级设置", "安全第一，金额不限。", "许多顾客余额不足。", "任何方案都有范围。", "石油价格上涨{num}元。", "江河湖海，山川田野。", "订单{long}已发货。", "何时开门？何处取票？", "路径错误，段落缺失。", "熊猫喜欢吃竹子，白鹤飞向南方。", "时代在变，武术馆开课。", "汤很好喝，田里有水，金鱼在游。", "管理员修改了平台应用。", "东方航空的飞机晚点了。", "司马光砸缸是个故事。", "雷雨天气不要出门。", "任课老师布置作业。",
    # Japanese
    "昨日{J}さんが来た。", "{J}様、お荷物です。", "先生は{J}です。", "{J}氏の絵を買った。", "隣の{J}さんと話す。", "氏名：{J}　電話：{N}", "{J}（{N}）", "{J}\t{E}", "{J} | {N}", "受取人は{J}、住所は{JA}。", "店長の{J}が謝罪した。", "{J}と{J}が結婚する。", "作者：{J}", "医師の{J}は休みだ。", "社長{J}氏が語る。", "出席者：{J}、{J}、{J}", "{J}さんの家は{JA}にある。", "携帯は{N}。", "予約は{N}へ。", "{E}に返信する。", "荷物を{JA}へ送る。", "マイナンバーは{I}。", "監督は{J}だ。", "{J}君、おはよう。", "大家の{J}に鍵を渡す。", "報告者 {J}", "{J}が料理を作る。",
    "皆様のご来店を待つ。", "お客様各位", "今日は{num}度で暑い。", "電車は{num}分遅れる。", "注文番号{long}を発送する。", "図書館と美術館は休館だ。", "営業部の担当者へ連絡する。", "東京駅から新幹線に乗る。", "会員登録と利用規約の確認", "山の上に小さな家がある。", "お母さんと娘さんが買い物をする。", "林業と農業の話。", "管理組合の総会を開く。", "店員さんに聞く。", "第{num}回定例会議", "原因を調べて報告書を出す。", "金子の返済期限", "運転手さん、ありがとう。", "神様にお願いする。",
    # Hindi
    "{H} ने कल खाना बनाया।", "श्री {H} आज नहीं आए।", "डॉ. {H} से मिलो।", "मेरी पड़ोसी {H} गाती हैं।", "{H} जी, नमस्ते।", "नाम: {H}, मोबाइल {N}", "{H} और {H} बाज़ार गए।", "यह चित्र {H} का है।", "लेखक {H}", "मेरा फ़ोन {N} है।", "{E} पर लिखें।", "आधार संख्या {I}", "आज मौसम अच्छा है और बच्चे खेल रहे हैं।", "ऑर्डर {long} भेज दिया गया।", "किताब मेज़ पर है।", "राम राम सबको, दुकान {num} बजे खुलेगी।", "कमल का फूल सुंदर है।",
    # Arabic
    "طبخ {B} العشاء أمس.", "السيد {B} غائب اليوم.", "قابلت الدكتور {B} في المقهى.", "جارتنا {B} تغني.", "قال {B} إن المطر قادم.", "الاسم: {B}، الجوال {N}", "{B} و {B} ذهبا إلى السوق.", "رسم هذه اللوحة {B}.", "الكاتب {B}", "رقم هاتفي {N}.", "راسلنا على {E}.", "رقم الهوية {I}", "الطقس جميل والأطفال يلعبون.", "تم شحن الطلب {long}.", "الكتاب على الطاولة.", "يفتح المتجر في الساعة {num}.",
    # Thai
    "คุณ{K}ทำอาหารเมื่อวาน", "นาย{K} ไม่มาวันนี้", "พบ ดร.{K} ที่ร้านกาแฟ", "เพื่อนบ้าน {K} ร้องเพลง", "ชื่อ: {K} มือถือ {N}", "{K} และ {K} ไปตลาด", "ผู้เขียน {K}", "เบอร์ของฉัน {N}", "เขียนถึง {E} ได้เลย", "เลขประจำตัวประชาชน {I}", "อากาศดีและเด็กกำลังเล่น", "จัดส่งคำสั่งซื้อ {long} แล้ว", "คุณสามารถเปิดร้านได้ {num} โมง", "หนังสืออยู่บนโต๊ะ",
]

# Words that sentences are composed of, by language: articles with nouns, verbs, prepositions, "and", titles, phrases.
GRAMMAR = {
    "en": ("the kettle|a ladder|our sofa|this recipe|the old bicycle|some bread|the garden|that violin|an umbrella|two tickets".split("|"), "found|lost|sold|painted|carries|repairs|cleaned|opened|brought|wants|borrowed|likes|dropped|hid|baked|measures".split("|"),
           "for|by|from|with|to|about|near|behind|via|of".split("|"), "and|or".split("|"), "Mr|Mr.|Mrs|Mrs.|Ms|Ms.|Dr.|Prof.|Sgt.|Miss".split("|"), "yesterday|in spring|at noon|before dinner|after the rain|on Monday|in {C}|during {num}|twice|again".split("|")),
    "de": ("der Kessel|eine Leiter|unser Sofa|das Rezept|das alte Fahrrad|die Wohnung|der Garten|den Hammer|die Heizung|zwei Karten".split("|"), "fand|verlor|verkauft|malt|trägt|repariert|putzte|öffnet|brachte|will|leiht|mag|backte|misst|holt".split("|"),
           "für|von|mit|bei|an|über|neben|durch|laut".split("|"), "und|oder".split("|"), "Herr|Herrn|Frau|Dr.|Frau Dr.|Herr Dr.|Prof.".split("|"), "gestern|im Frühling|am Mittag|vor dem Essen|nach dem Regen|am Montag|in {C}|zweimal|wieder|seit {num}".split("|")),
    "fr": ("le vélo|une échelle|notre canapé|la recette|le vieux violon|du pain|le jardin|la clé|un parapluie|deux billets".split("|"), "trouve|perd|vend|peint|porte|répare|nettoie|ouvre|apporta|veut|emprunte|aime|cuit|mesure".split("|"),
           "pour|par|de|avec|à|chez|selon|sur|vers".split("|"), "et|ou".split("|"), "M.|Mme|Mlle|Dr|Monsieur|Madame|Me".split("|"), "hier|au printemps|à midi|avant le dîner|après la pluie|lundi|à {C}|encore|depuis {num}".split("|")),
    "es": ("la bicicleta|una escalera|nuestro sofá|la receta|el viejo violín|el pan|el jardín|la llave|un paraguas|dos entradas".split("|"), "encontró|perdió|vende|pinta|lleva|repara|limpia|abre|trajo|quiere|presta|cocina|mide".split("|"),
           "para|por|de|con|a|sobre|según|hacia".split("|"), "y|o".split("|"), "Sr.|Sra.|Srta.|Dr.|Dra.|Don|Doña|el Sr.|la Sra.".split("|"), "ayer|en primavera|al mediodía|antes de cenar|tras la lluvia|el lunes|en {C}|otra vez|desde {num}".split("|")),
}
FORMS = [  # N noun, V verb, R preposition, J "and", H title, O phrase
    "{P} V N.", "O {P} V N.", "N V R {P}.", "N V R {P} O.", "{P} J {P} V N.", "{S} J {P} V N.", "{S} J {S} V N.", "{G} J {G} V N.", "{S}, {S} J {S} V N.", "{P}, {P} J {P} V N.", "H {S} V N.", "H {P} V N.", "N R H {S} V N.", "N R H {S} J H {S} O.", "N R H {P} R {num}.", "N R {P}, N V O.",
    "{P} ({N}) V N.", "{P} ({E}) V N.", "{P} ({I}) V N.", "N R {P} ({E}).", "{P}, {A}, V N.", "N V R {A}.", "N V {N} O.", "N V R {E} O.", "N V {I}.", "{I} V N.", "{N} V N.", "{E} V N.", "{A} V N.", "{P}; {I}; {N}", "{P} | {I} | {A}", "{I}\t{P}", "{N}\t{A}", "{E}, {N}", "({N})", "({I})", "{P}: {I}", "{P} - {A}", "H {S}, {N}", "R {P}\n", "R {P} J {P}\n", "{P}, {num}", "N: {P}", "{P} {P} {P} {P}", "N: {P} {P} {P} {P} V N.", "{P} {P} V N.", "N: {G}, {G}",
    "N V N O.", "N V N R N.", "N V {num} R N.", "N V {long} R N.", "N {build} V N.", "N {part} V N.", "N {range} V N.", "{T} V N.", "N R {T} V N.", "{C} V N O.", "N J N V N.", "O N V N.", "N ({num}) V N.", "N ({range})", "N # {long}", "{T}: N", "N R {C} J {C} V N.",
]
ZH_LINKS = "在 是 和 的 把 需要 已经 可以 没有 正在 影响 包含 等于 用于 来自 属于 超过".split()
JA_LINKS = "は が を に で と の も へ から まで より".split()
JA_ENDS = "する。 した。 である。 ます。 だ。 になる。 がある。 を見る。 を開く。 を送る。".split()


def compose(r: random.Random) -> str:
    """A template of a sentence, by the grammar of a language."""
    lang = r.choice(["en", "en", "de", "fr", "es", "zh", "zh", "ja", "ja"])

    def other(words: list[str]) -> str:
        """A common word, or characters of such words in another order: the lists don't hold every word."""
        if r.random() < 0.6:
            return r.choice(words)
        return "".join(r.choice(r.choice(words)) for _ in range(r.choice([2, 2, 3, 4])))

    if lang == "zh":
        words = [other(L.ZH_COMMON) if r.random() < 0.75 else r.choice(sorted(L.ZH_WORDS)) for _ in range(4)]
        one = f"{words[0]}{r.choice(ZH_LINKS)}{words[1]}"
        return r.choice([one + "。", one + f"{words[2]}，{words[3]}。", f"{words[0]}{words[1]}", f"{words[0]}：{words[1]}", f"{one}{{Z}}。", f"{{Z}}{r.choice(ZH_LINKS)}{words[0]}。", f"{words[0]}{{Z}}{r.choice(ZH_LINKS)}{words[1]}。", f"{{Z}}、{{Z}}{words[0]}{words[1]}。", f"{words[0]}由{{Z}}{words[1]}。", f"{one}{{N}}，{words[2]}。", f"{one}{{ZA}}。", f"{words[0]}{{I}}{words[1]}。", f"{words[0]}：{{Z}}，{{E}}", f"{{Z}} / {{N}}", f"{one}{{num}}{words[2]}。", f"{{Z}}（{{N}}）{words[1]}。"])  # noqa: F541
    if lang == "ja":
        words = [other(L.JA_COMMON) for _ in range(4)]
        link = lambda: r.choice(JA_LINKS)
        end = r.choice(JA_ENDS)
        return r.choice([f"{words[0]}{link()}{words[1]}{end}", f"{words[0]}{link()}{words[1]}{link()}{words[2]}{end}", f"{words[0]}{words[1]}{link()}{words[2]}{end}", f"# {words[0]}{words[1]}", f"{words[0]}、{words[1]}、{words[2]}", f"{words[0]}（{words[1]}）", f"{words[0]} {words[1]}", f"{words[0]}：{words[1]}{words[2]}", f"{words[0]}{link()}{{J}}さん{end}", f"{{J}}{r.choice(['さん', '氏', '様'])}{link()}{words[0]}{end}", f"{words[0]}は{{J}}（{{N}}）{end}", f"{words[0]}は{{J}}氏{end}", f"{words[0]}{link()}{{N}}{end}", f"{words[0]}は{{JA}}{end}", f"{{JA}}{link()}{words[0]}{end}", f"{words[0]}：{{JA}}", f"{{J}} / {{N}}", f"{{J}}、{words[0]}", f"{words[0]}{{num}}{words[1]}{end}", f"{words[0]}{link()}{{I}}{end}"])  # noqa: F541
    nouns, verbs, preps, links, titles, phrases = GRAMMAR[lang]
    pick = {"N": nouns, "V": verbs, "R": preps, "J": links, "H": titles, "O": phrases}
    out = re.sub(r"(?<![{\w])[NVRJHO](?![}\w])", lambda m: r.choice(pick[m.group()]), r.choice(FORMS))
    return out[0].upper() + out[1:]


def make(n: int, seed: int = 11, templates: list[str] | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of a few sentences with their mentions (kind, start, end)."""
    r = random.Random(seed)
    given_templates = templates is not None
    templates = templates or TEMPLATES

    def digits(pattern: str) -> str:
        return re.sub("9", lambda _: str(r.randrange(10)), pattern)

    def invented() -> str:
        s = "".join(r.choice(ONSETS) + r.choice(VOWELS) for _ in range(r.choice([1, 1, 2]))) + r.choice(CODAS + ENDS + [""])
        return (s if len(s) > 3 else s + r.choice(ENDS)).capitalize()

    def given() -> str:
        return r.choice(sorted(L.GIVEN_LATIN)) if r.random() < 0.6 else invented()

    def surname() -> str:
        s = r.choice(L.SURNAMES) if r.random() < 0.3 else invented() if r.random() < 0.7 else invented() + r.choice(["wood", "field", "bach", "mann", "ville", "stone"])
        form = r.random()
        if form < 0.05:
            return r.choice(["von ", "de ", "van ", "O'", "Mc", "D'"]) + s
        return f"{s}-{invented()}" if form < 0.1 else s

    def initial() -> str:
        return r.choice("ABCDEFGHIJKLMNOPRSTVW") + "."

    def person() -> str:
        g, s, form = given(), surname(), r.random()
        if form < 0.56:
            out = f"{g} {s}"
        elif form < 0.64:
            out = f"{g} {initial()} {s}"
        elif form < 0.73:
            out = f"{initial()} {s}"
        elif form < 0.78:
            out = f"{initial()} {initial()} {s}"
        elif form < 0.84:
            out = f"{g} {given()} {s}"
        else:
            out = f"{s}, {g}" + (f" {initial()}" if r.random() < 0.3 else "")
        return out.upper() if r.random() < 0.06 else out

    def email() -> str:
        g, s = re.sub("[^a-z]", "", given().lower()) or "kim", re.sub("[^a-z]", "", surname().lower())
        local = r.choice([f"{g}.{s}", f"{g[0]}{s}", f"{s}_{g}", f"{g}{r.randrange(99)}", f"{g}.{s}+news", f"{g}-{s}"])
        if r.random() < 0.1:
            local = local.title()
        host = r.choice(["mailbox.example", "uni-waldau.example", "post.test", "shop.kirkwell.invalid", "firma.example.org"])
        form = r.random()
        if form < 0.75:
            return f"{local}@{host}"
        if form < 0.86:
            return f"{local}{r.choice(['(at)', '[at]', ' (at) '])}{host}"
        return f"{local} [at] {host.replace('.', ' [dot] ')}" if form < 0.95 else f"{local.lower()} at {host.replace('.', ' dot ')}"

    def phone() -> str:
        return digits(r.choice(["+1 999 999 9999", "+1-999-999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "1 999 9999999", "+44 99 9999 9999", "+44 (0)99 99999999", "099 9999 9999", "(099) 9999 9999", "+49 99 99999999", "099 99999 999", "099/99999999", "0049 (0)99 99999-999", "+49 (99) 99999 999", "09 99 99 99 99", "09.99.99.99.99", "09-99-99-99-99", "0999999999", "+33 9 99 99 99 99", "+33 (0)9 99 99 99 99", "999 999 999", "999-999-999", "+34 999 999 999", "(+34) 999999999", "099-99999999", "（099）99999999", "13999999999", "+86 139 9999 9999", "+81 9 9999 9999", "09-9999-9999", "099-9999-9999", "+91 99999 99999", "+66 9 9999 9999", "+20 99 9999 9999"]))

    def identity() -> str:
        letter, two = r.choice("ABCDEFGHJKLMNPQRSTVWXYZ"), "".join(r.sample("ABCEGHJKLMNPQRSTWXYZ", 2))
        return digits(r.choice(["999-99-9999", "999-99-9999", "999 99 9999", "999.99.9999", "999999999", f"{two} 99 99 99 {letter}", f"{two}999999{letter}", f"{two.lower()} 999999 {letter.lower()}", f"99.999.999-{letter}", f"99999999-{letter}", f"99999999{letter}", f"X9999999{letter}", "2 99 99 99 999 999 99", "199999999999999", "999999199912319999", "99999919991231999X", "9999 9999 9999", "99 999 999 999", "999.999.999-99", "9-9999-99999-99-9", "ABCPK9999F"]))

    def address() -> str:
        n, name, town = r.randrange(1, 260), invented(), r.choice([*TOWNS, invented()])
        kind = r.randrange(4)
        if kind == 0:
            out = f"{n}{r.choice(['', '', 'b'])} {name}{r.choice(['', ' ' + invented()])} {r.choice(['Street', 'Road', 'St.', 'Rd', 'Avenue', 'Ave', 'Lane', 'Way', 'Close', 'Crescent', 'Terrace', 'Row', 'Blvd', 'Drive', 'Court', 'Place', 'Square'])}"
            out += r.choice(["", "", f", Flat {n}", f", Apt. {n}b", f" Unit {n}"]) + r.choice(["", f", {town}" + r.choice(["", digits(" AB9 9CD"), digits(", EF9 9GH"), digits(", KY 99999"), digits(" 99999")])])
        elif kind == 1:
            out = f"{r.choice([name + 'straße', name + 'str.', name + 'weg', name + 'er Allee', name + 'gasse', name + 'platz', 'Am ' + name, 'Zur ' + name])} {n}{r.choice(['', '', 'a', ' c'])}" + r.choice([digits(", 99999 ") + town, digits(", 99999 ") + town, ""])
            if out.startswith(("Am ", "Zur ")) and "," not in out:
                out += digits(", 99999 ") + town
        elif kind == 2:
            out = f"{n}{r.choice([',', '', ' bis,'])} {r.choice(['rue de ', 'rue du ', 'impasse ', 'av. de ', 'avenue des ', 'boulevard ', 'chemin de ', 'place '])}{name}" + r.choice([digits(", 99999 ") + town, ""])
        else:
            out = f"{r.choice(['Calle ', 'Avda. de ', 'C/ ', 'Plaza de ', 'Paseo de la ', 'Camino '])}{name}{r.choice([', ', ', n.º ', ' '])}{n}{r.choice(['', ', 2.º C', ', 4.º'])}" + r.choice([digits(", 99999 ") + town, ""])
        return out

    def chinese() -> str:
        family = r.choice(L.ZH_DOUBLE) if r.random() < 0.4 else r.choice(sorted(L.ZH_SINGLE))
        pool = sorted(L.ZH_GIVEN) if r.random() < 0.8 else "溪松柏竹兰菊荷莲桐枫槐榆桂杉柳泉石峰岭川"
        return family + "".join(r.sample(pool, r.choice([1, 2, 2])))

    def japanese() -> str:
        family = r.choice(L.JA_SURNAMES) if r.random() < 0.6 else "".join(r.sample("山川田野原島崎沢谷森林石岩松竹梅桜藤橋水北南西東高大小上下中村井浦", r.choice([2, 2, 2, 3, 1])))
        given = "".join(r.sample(sorted(L.JA_GIVEN), r.choice([2, 2, 2, 3, 1]))) if r.random() < 0.85 else r.choice(["さくら", "ひかり", "みお", "ケン", "あおい"])
        return family + r.choice(["", "", " ", "　"]) + given

    def two(first: list[str], last: list[str]) -> str:
        form = r.random()
        return f"{r.choice(first)} {r.choice(last)}" if form < 0.7 else r.choice(first)

    def chinese_address() -> str:
        town, district = "".join(r.sample("青云江海宁安泰清源福临永", 2)), "".join(r.sample("城东西南北新河湖山阳", 2))
        return f"{r.choice(['', town[::-1] + '省'])}{town}市{district}{r.choice('区县')}{r.choice(['解放', '人民', '和平', '建设', '长青'])}{r.choice('路街巷道')}{r.randrange(1, 300)}号{r.choice(['', f'{r.randrange(1, 9)}栋', f'{r.randrange(1, 9)}单元', f'{r.randrange(101, 909)}室'])}"

    def japanese_address() -> str:
        return r.choice(["", digits("〒999-9999 ")]) + f"{''.join(r.sample('千富岡福長高松山川', 2))}{r.choice('県府都')}{''.join(r.sample('千富岡福長高松山川', 2))}{r.choice('市区町村')}{r.choice(['', '本町', '栄'])}{r.randrange(1, 9)}{r.choice(['-', '丁目'])}{r.randrange(1, 40)}{r.choice(['', f'-{r.randrange(1, 9)}', '番'])}"

    def thing() -> str:
        return f"{r.choice(THINGS + [invented()])} {r.choice(KINDS_OF)}"

    make_slot = {
        "Z": ("person", chinese), "J": ("person", japanese), "ZA": ("address", chinese_address), "JA": ("address", japanese_address),
        "H": ("person", lambda: two(L.HI_GIVEN, L.HI_FAMILY)), "B": ("person", lambda: two(L.AR_GIVEN, L.AR_FAMILY)), "K": ("person", lambda: two(L.TH_GIVEN, L.TH_FAMILY)),
        "P": ("person", person), "G": ("person", given), "S": ("person", surname), "E": ("email", email), "N": ("phone", phone), "I": ("id_number", identity), "A": ("address", address),
        "num": (None, lambda: str(r.randrange(1, 9999))), "w": (None, lambda: r.choice(WORDS)), "W": (None, lambda: r.choice(NOUNS)), "C": (None, lambda: r.choice([*TOWNS, invented(), "New " + invented(), invented() + " Bay"])), "T": (None, thing),
        "ver": (None, lambda: digits(r.choice(["9.9.9", "9.99", "99.99.99"]))), "part": (None, lambda: digits(r.choice(["9999.9999.9999", "999.9999.9999", "9999.999.9999", "99-9999-99"]))),
        "build": (None, lambda: digits(r.choice(["9999-9999-9", "9999-9999-99", "999-9999-9"]))), "range": (None, lambda: digits(r.choice(["9999-9999", "999-9999", "99-9999"]))), "long": (None, lambda: digits(r.choice(["99999999999", "999999999", "9999999999", "999999999999"]))),
    }
    out = []
    for _ in range(n):
        text, mentions = "", []
        chosen = r.sample(templates, min(len(templates), r.randrange(3, 7)))
        for t in chosen if given_templates else [compose(r) if r.random() < 0.5 else t for t in chosen]:
            alone = "\t" in t or "|" in t or ";" in t or t.startswith(("#", "-", "*", "CC", "Reviewed")) or not re.search(r"[.!?。！？।:：,]$", t)
            text += "" if not text else "\n" if alone or text.endswith("\n") else r.choice([" ", " ", "\n"])
            at = 0
            for m in re.finditer(r"\{(\w+)\}", t):
                text += t[at : m.start()]
                kind, f = make_slot[m.group(1)]
                value = f()
                if kind:
                    mentions.append((kind, len(text), len(text) + len(value)))
                text += value
                at = m.end()
            text += t[at:] + ("\n" if alone else "")
        out.append((text, mentions))
    return out
