"""Words of nine languages that the redaction model's features ask for.  All are fixed values, common words and
common names of each language; the model is trained with names in and out of these lists."""

from __future__ import annotations


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Common given names.
GIVEN_EN = "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra Paul Ashley Steven Emily Andrew Donna Kenneth Michelle George Carol Kevin Helen Brian Edward Rachel Peter Laura Samuel Alice Henry Grace Jack Oliver Ruth".split()
GIVEN_DE = "Karl Hans Jürgen Klaus Wolfgang Uwe Stefan Andreas Monika Petra Sabine Ursula Renate Heike Katrin Anja Lukas Felix Greta Lena Dieter Holger Matthias Ingrid Birgit Anke Jens Florian Johanna Friedrich".split()
GIVEN_FR = "Jean Pierre Michel Philippe Alain Nicolas Julien Camille Sophie Marie Nathalie Isabelle Céline Chloé Léa Manon Antoine Hugo Louis Claire François Étienne Benoît Amélie Thierry Laurent Sylvie Élise Mathilde Guillaume".split()
GIVEN_ES = "José Juan Antonio Manuel Francisco Javier Carlos Miguel Alejandro Pedro Pablo Luis María Carmen Ana Isabel Dolores Pilar Teresa Rosa Lucía Elena Marta Sofía Álvaro Inés Ramón Rocío Andrés Beatriz".split()
GIVEN_LATIN = frozenset(GIVEN_EN + GIVEN_DE + GIVEN_FR + GIVEN_ES)
SURNAMES = "Smith Jones Taylor Brown Wilson Evans Walker Wright Hughes Bennett Whitfield Carter Müller Schmidt Weber Fischer Wagner Becker Schäfer Lindqvist Braun Vogel Krüger Lehmann Martin Bernard Dubois Moreau Lefèvre Marchand Girard Fontaine Mercier Blanchard García López Martínez Sánchez Fernández Gómez Ruiz Herrera Castillo Vargas Ortega Molina Rossi Novak Kowalski Jensen Larsen O'Brien McCarthy D'Angelo Singh Patel Nguyen Tanaka".split()
HI_GIVEN = "राम मोहन राजेश सुनीता अनिल विजय प्रिया रमेश सीता गीता अमित नेहा पूजा संजय राहुल सुरेश कविता दीपक मनोज रेखा आनंद किरण अर्जुन मीना लक्ष्मी हरीश कमला विकास पंकज रवि".split()
HI_FAMILY = "शर्मा वर्मा गुप्ता सिंह कुमार यादव पटेल मिश्रा जोशी अग्रवाल देवी चौधरी मेहता नायर खान तिवारी पांडे राव".split()
AR_GIVEN = "محمد أحمد محمود علي حسن حسين خالد عمر يوسف إبراهيم فاطمة عائشة مريم زينب ليلى سارة نور سعيد مصطفى طارق سامي رامي هدى منى سلمى كريم ياسر نادية عبد جمال".split()
AR_FAMILY = "المصري الحسن السيد النجار الحداد الخطيب العلي الشريف القاسم الأحمد منصور حمدان سليمان صالح ناصر عثمان يعقوب داود".split()
TH_GIVEN = "สมชาย สมหญิง สมศรี วิชัย ประเสริฐ สุดา มานะ มานี ปิติ ชูใจ อนันต์ กมล นภา วรรณา สุรชัย ธนพล ณัฐพล อรุณ ศิริพร พิมพ์ใจ จันทร์เพ็ญ บุญมี ไพศาล รัตนา".split()
TH_FAMILY = "ใจดี รักไทย ศรีสุข แสงทอง บุญมา ทองดี วงศ์สุวรรณ สุขใจ พงษ์ไพบูลย์ มั่นคง เจริญสุข ชัยมงคล".split()
# Chinese and Japanese: family names, and characters that given names are made of.
ZH_DOUBLE = "欧阳 司徒 皇甫 闻人 上官 诸葛 东方 尉迟 公孙 慕容 令狐 司马 夏侯 端木 南宫 独孤 长孙 宇文 钟离 轩辕 百里 呼延".split()
ZH_SINGLE = frozenset("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文")
ZH_GIVEN = frozenset("伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红梅建国志鹏飞宇浩欣怡梓涵思雨晨佳琪雪琳婷晓东海波云岚清远书瑶墨天齐辰子轩博诗语桐若曦嘉文俊凯峰龙慧颖倩莉春燕丹凤")
# Common words that begin with a character that is a family name too.
ZH_WORDS = _words("文件 文档 文本 文字 文章 文书 方法 方案 方式 方面 方便 方向 程序 程度 高级 高度 高于 高亮 任务 任何 任意 万一 万元 常见 常用 常规 常量 易于 白天 白名 金额 金属 石油 许多 许可 于是 曾经 何时 何处 何种 马上 江河 黄色 周一 周二 周三 周四 周五 周六 周日 周期 周末 时间 张贴 钟表 钱包 安全 段落 陈述 陈列 应用 余额 余下 顾客 顾问 范围 夏季 平台 史料 谢谢 康复 田地 雷达 叶子 梁柱 孔径 武器 包括 汤品 侯选 龙头 毛利 林业 罗列 严格 单元 解决 管理 关于 温度 路径 左右 项目 区域 东方 万能 白板 高峰 文员 方才 程式 常务 常驻 易用 任职 任期 康宁")
JA_SURNAMES = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 前田 藤田 小川 岡田 後藤 長谷川 村上 近藤 石井 坂本 遠藤 青木 藤井 西村 福田 太田 三浦 岡本 松田 中島 中野 原田 小野 田村 竹内 金子 和田 中山 石田 上田 森田 原 柴田 酒井 宮崎 横山 高木 安藤 宮本 大野 小島 谷口 工藤 今井 増田 丸山 杉山 村田 大塚 新井 平野 菅原 武田 久保 松井 野口 岩崎 桜井 五十嵐 小野寺 北沢 森川".split()
JA_GIVEN = frozenset("子美太郎一介斗香奈恵樹翔健大輔誠直由紀花真春夏秋冬優愛菜結衣陽蓮悠葵咲希智和彦夫雄男江代里穂乃沙理佳央平也哉良司治次三二")
JA_THINGS = frozenset("部課組社会者係室所県市区町村店局院校館庫版号条項表票書類帳簿録点件名様式数値用法性化的時分日月年週間前後内外中上下先元")

# Common words of Chinese and Japanese that are no names.
ZH_COMMON = "天气 市场 孩子 音乐 电影 学校 图书 花园 厨房 火车 飞机 晚饭 早餐 医院 衣服 朋友 故事 比赛 游戏 照片 蔬菜 水果 河流 山路 邮局 房间 窗户 桌子 椅子 钥匙 报纸 新闻 历史 地理 数学 语言 文化 艺术 体育 旅行 目标 结果 原因 条件 数量 质量 价格 费用 规定 通知 公告 配件 仓库 货物 客户 部门 小组 会议 报告 申请 审批 流程 步骤 系统 网络 密码 账户 数据 版本 更新 备份 保存 删除 搜索 打印 扫描 温度 湿度 重量 长度 速度 标签 编码 字段 表格 图片 附件 链接 地图 坐标 范例 练习".split()
JA_COMMON = "天気 市場 子供 音楽 映画 学校 図書 花壇 台所 列車 夕食 朝食 病院 洋服 友人 物語 試合 写真 野菜 果物 河川 山道 郵便局 部屋 窓 机 椅子 新聞 歴史 地理 数学 言語 文化 芸術 運動 旅行 計画 目標 結果 原因 条件 数量 品質 価格 費用 契約 清単 目録 見本 記録 索引 日誌 雛形 説明 手引 通知 公告 覚書 書庫 章節 辞典 設備 部品 倉庫 荷物 顧客 社員 部門 会議 報告 申請 承認 手順 工程 出張 精算 経費 棚卸 在庫 発注 納品 検査 点検 温度 湿度 重量 長さ 速度 符号 項目 表 画像 添付 地図 座標 例題 練習 一覧表 管理表 申請書 稟議書 議事録 作業手順 更新履歴 検索結果 設定画面 利用規約 在庫管理 品質保証 勤怠管理 中間報告 月次処理 年末調整 緊急連絡網 三者面談 小計 大型 高速 上限値 中央値 木材 林道 森林 原料 本棚 田畑 石材 金額 青色".split()

TITLES = _words("mr mrs ms miss dr prof sir madam frau fräulein herr herrn dipl ing monsieur madame mademoiselle m mm mme mlle me sr sra srta don doña señor señora señorita dra lic rev capt col lt sgt maj officer judge nurse professor doctor doktor docteur maître")
GREETINGS = _words("hi hello dear hey hallo liebe lieber guten servus bonjour bonsoir salut cher chère coucou hola estimado estimada querido querida buenas")
DETERMINERS = _words("the a an this that these those our your each every no any some another der die das den dem des ein eine einen einem einer kein keine diese dieser dieses diesem unser unsere jede jeder jedes le la les l un une du des ce cette ces notre nos votre chaque aucun el los las una unos unas este esta estos nuestro nuestra cada ningún lo al del am im zum zur vom beim ins ans aux au")
PREPOSITIONS = _words("to by from with for via per through about against of behind beside von mit an bei für durch gegen über laut par de à avec pour chez selon por con para a según ante in on at under nach aus auf wegen en sur dans")
CONJUNCTIONS = _words("and or und oder et ou y e o & as well plus sowie")
LABELS = _words("name from to cc bcc attn contact signed by author owner sender recipient client patient tenant user employee approver reviewer applicant witness regards sincerely thanks von an kontakt mieter absender empfänger bearbeiter unterschrift gez nom expéditeur destinataire auteur signataire contacto nombre remitente cliente firmado atentamente cordialmente grüße gruß")
ROLES = _words("director manager engineer tenant colleague client customer clerk patient author witness applicant owner employee secretary accountant lawyer neighbour neighbor driver teacher student editor analyst officer assistant technician inspector mieter kunde kundin kollege kollegin leiter leiterin antragsteller mitarbeiter mitarbeiterin nachbar patientin sachbearbeiter cliente compañero compañera jefe directora empleado empleada vecino vecina paciente inquilino abogado testigo client cliente collègue directeur directrice voisin voisine patiente locataire avocat témoin ingénieur salarié salariée")
BEFORE = _words("ask asked tell told call called contact met meet saw see thank thanked invite inform informed visit visited notify named remind reminded frag fragen bat rief traf trifft informieren kontaktieren demande demandez appelez contactez prévenez rencontré remercie pregunte pregunta avisar contacte visite conoció agradece saludó")
AFTER = _words("signed said wrote asked moved lives lived works worked called sent has had is was will would can could says owns left joined told replied paid agreed noted explains confirmed hat ist war wird wohnt wohnte zog sagte schrieb arbeitet meint bat kam will kann lebt unterschrieb a est était habite demeure travaille dit écrit signe arrive propose vit ha es fue era vive trabaja dijo escribió firmó pidió llegó tiene quiere who whose whom qui dont que quien cuyo der deren dessen born née geboren nacido nacida alias")
FUNCTION = TITLES | GREETINGS | DETERMINERS | PREPOSITIONS | _words("""if when where while why how what which who then than there here but nor so yet because although please note see keep never always also only just not
    do does did are were be been being shall should may might must it its we you they he she i his her their my us them all both most many few more less other such next last first second new old
    wenn wann warum wie was welche wer dann als dort hier aber denn doch weil obwohl bitte siehe nie immer auch nur nicht sind waren sein sollte darf muss es wir sie er ich ihr sein seine ihre alle beide viele mehr andere nächste letzte erste neue alte seit während ohne trotz unter vor zwischen
    si quand où pourquoi comment quel quelle alors mais car donc parce veuillez voir jamais toujours aussi seulement ne pas sont étaient être doit peut il elle nous vous ils elles je son sa ses leur tous toutes plusieurs plus autre prochain dernier premier nouvelle nouveau après avant pendant sans sous entre
    cuando donde cómo qué cuál entonces pero porque aunque favor véase nunca siempre también solo no son eran ser debe puede él ella nosotros usted ellos yo su sus todos todas varios más otro próximo último primero nueva nuevo después antes durante sin bajo entre desde hasta""") - _words("will mark may sein miss me")
THINGS = _words("""team board group department office committee council company limited ltd inc corp llc gmbh ag co kg sa sarl association agency bank university college school institute hospital library museum church station hall building tower house centre center
    street road avenue lane way close crescent terrace row boulevard drive court place square gardens park hill bridge airport port harbour harbor river lake county city town village north south east west
    policy guide manual report version release plan project product service system server client database table index archive folder file form page section chapter appendix figure note list order invoice contract notice budget survey request ticket incident account agreement process procedure schedule checklist summary overview review audit training onboarding access security data network support sales finance legal marketing engineering operations quality compliance privacy retention
    general annual quarterly monthly weekly daily central national international standard premium basic senior junior chief head executive regional deputy assistant lead prime pro plus edition series model unit
    monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december tel phone fax email id ssn flat apt suite floor room
    abteilung bericht richtlinie handbuch ordner vertrag rechnung antrag formular verzeichnis liste tabelle leitung einkauf vertrieb prüfung ausschuss gesellschaft verein amt behörde stadt straße platz
    service département bureau comité société rapport guide manuel dossier contrat facture demande formulaire registre direction équipe ville rue place
    departamento oficina comité empresa informe guía manual carpeta contrato factura solicitud formulario registro dirección equipo ciudad calle plaza""")
THING_ENDS = ("ung", "heit", "keit", "schaft", "tät", "tion", "tions", "ment", "ments", "ness", "ity", "ing", "ings", "ción", "dad", "nis", "tum", "age", "ance", "ence", "ism", "ware", "line", "frist", "stelle")
GERMAN = _words("der die das und ist nicht den dem ein eine mit von für auf wird werden im zu bei nach oder wir sie")

PHONE_WORDS = "tel tél telephone telefon teléfono téléphone phone mobile mobil móvil portable cell fax call calls called dial text texted ring rang hotline helpline anruf anrufen rufen ruf rückruf durchwahl erreichbar appel appeler appelez joindre joignable llame llamar llamada marque whatsapp sms callback number nummer numéro número 电话 手机 拨打 致电 联系电话 電話 携帯 内線 फ़ोन फोन मोबाइल कॉल هاتف الهاتف جوال اتصل الاتصال โทร โทรศัพท์ เบอร์".split()
ID_WORDS = "ssn social security insurance nino national identity identification id ids passport tax taxpayer citizen personal ausweis personalausweis steuer-id steuernummer sozialversicherung sozialversicherungsnummer versicherungsnummer identifikationsnummer sécurité sociale nir carte identité fiscal dni nif nie cif documento identidad afiliación curp rfc cpf 身份证 身份证号 证件 护照 マイナンバー 個人番号 旅券 आधार पैन पहचान هوية الهوية الوطنية جواز บัตรประชาชน บัตร ประจำตัว ssn: born birth geboren née nacido".split()
CODE_WORDS = "order orders part parts build version ver release range ticket inc checksum hash code serial sku item article invoice batch lot isbn article-no revision commit port error line row rows page pages limit route account booking reference ref case tracking meter record bestellung auftrag artikel charge teil teilenummer rechnung seriennummer zeile stand commande pièce facture série ligne lot réf pedido pieza factura serie línea lote ref 订单 版本 编号 单号 批次 合计 注文 版 番号 ऑर्डर चालान संस्करण طلب فاتورة إصدار نسخة คำสั่งซื้อ รุ่น ใบแจ้งหนี้ รหัส".split()
ADDRESS_WORDS = "address lives live living resides residing home ship send deliver delivery mail post parcel located office anschrift adresse wohnt wohnhaft lieferung senden paket versand habite demeure domicile livrer livraison colis envoyer dirección vive reside domicilio enviar envío paquete entrega 地址 住址 寄 送货 住所 送付 配送 届け पता عنوان العنوان ที่อยู่".split()
# Honorifics of scripts without capitals: before a name, and behind one.
HI_BEFORE = _words("श्री श्रीमती सुश्री डॉ डॉ. प्रो प्रो. कुमारी पंडित")
HI_AFTER = _words("जी ने को से का की के साहब")
AR_BEFORE = _words("السيد السيدة الأستاذ الأستاذة الدكتور الدكتورة المهندس المهندسة الآنسة الشيخ د. أ.")
TH_BEFORE = "นางสาว นาย นาง คุณ ดร. เด็กชาย เด็กหญิง ศาสตราจารย์".split()
ZH_AFTER = "先生 女士 小姐 老师 主任 经理 医生 教授 同学 律师 总 处长 同志 夫人".split()
JA_AFTER = "さん 氏 様 君 殿 ちゃん 先生 部長 課長 社長 主任 教授 女史".split()
ZH_STOP = frozenset("的了是在和与或与被把不这那及对从到以为其有就也都而但并且若如因所于可能会应需将已经未无每各按请让")
