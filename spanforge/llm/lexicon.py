"""Word classes of names and ordinary words, by language, from general knowledge.

They are evidence for the model and no condition: training hides each of them
in part, so that words no list has are judged by their endings, their shape and
the text around them.
"""

from __future__ import annotations

import unicodedata


def _words(*texts: str) -> frozenset[str]:
    return frozenset(w for t in texts for w in t.split())


GIVEN = _words(
    # English
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony donald mark paul steven andrew kenneth joshua kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory frank alexander raymond patrick jack dennis jerry tyler aaron jose henry adam douglas nathan peter zachary kyle walter harold carl arthur gerald roger keith lawrence sean christian albert joe ethan austin jesse willie billy bruce ralph roy eugene louis philip bobby johnny barack donald graham colin nigel trevor ian alan neil stuart gareth rhys owen liam noah oliver elijah lucas mason logan aiden harvey oscar leo finley",
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia dorothy amy kathleen angela shirley emma brenda pamela nicole anna samantha katherine christine debra rachel carolyn janet catherine maria heather diane olivia julie joyce victoria ruth virginia lauren kelly christina joan evelyn judith andrea hannah megan cheryl jacqueline martha teresa gloria sara janice ann kathryn abigail sophia frances jean alice judy isabella julia grace amber denise danielle marilyn beverly charlotte natalie theresa diana brittany doris kayla alexis lori tiffany fiona moira bridget eleanor harriet imogen phoebe chloe ella lily mia zoe hazel ivy violet daisy poppy jane kate lucy molly nora",
    # German, Dutch, Nordic
    "hans peter wolfgang klaus jürgen dieter manfred uwe helmut günter gerhard bernd heinz horst werner karl josef stefan andreas thomas matthias markus martin frank jörg ralf sven torsten thorsten kai lars jens jan tim lukas leon felix maximilian moritz jonas niklas fabian sebastian tobias florian philipp dominik rolf kurt ernst friedrich otto ludwig heinrich hermann johann konrad rudolf siegfried ulrich volker ingo holger heiko dirk arne bjarne ulf axel detlef eckhard gerd gunnar",
    "ursula monika petra elke sabine renate karin brigitte ingrid erika christa gisela andrea susanne heike birgit claudia martina angelika gabriele silke anja katrin kerstin nicole stefanie julia katharina lena leonie hannah johanna frieda greta clara charlotte mathilda heidi annika svenja wiebke antje maren imke gudrun sigrid hildegard waltraud irmgard edith lieselotte lotte marlene franziska theresa",
    "willem pieter kees joost bram daan sem thijs ruben sander maarten wouter gijs jeroen marloes anouk femke sanne lieke maaike marieke saskia renske tineke johan erik anders nils olof lars magnus fredrik henrik gustav oskar hugo axel sten bengt göran björn leif håkan mikael mats stig einar eirik olav knut harald sigurd thor torben søren jens niels rasmus mads jesper kasper freja astrid ingeborg solveig liv maja ebba elsa saga linnea signe karin kerstin britta ulrika birgitta helga gunilla aino eino jukka mikko pekka timo juha matti antti ville sari päivi riitta",
    # French
    "jean pierre michel philippe alain bernard andré jacques rené marcel louis françois christian daniel gérard patrick claude nicolas julien sébastien guillaume antoine thibault mathieu vincent laurent olivier pascal thierry didier yves hervé gilles bruno stéphane frédéric christophe étienne luc émile gaston rémi benoît cédric fabrice arnaud yannick loïc théo hugo raphaël gabriel adrien baptiste quentin marie jeanne françoise monique catherine nathalie isabelle sylvie anne martine christine nicole véronique sandrine valérie sophie céline aurélie camille chloé manon inès léa juliette margaux amélie élodie émilie hélène odette simone yvette colette geneviève brigitte delphine solange",
    # Spanish, Portuguese, Italian
    "josé juan antonio manuel francisco javier carlos miguel alejandro rafael pedro daniel fernando luis sergio pablo jorge alberto diego adrián raúl álvaro enrique vicente ramón andrés joaquín santiago eduardo víctor rubén iván óscar ignacio gonzalo jaime emilio ricardo salvador marcos mateo ángel hugo carmen maría ana isabel dolores pilar teresa rosa cristina francisca antonia lucía mercedes elena concepción josefa paula raquel rocío beatriz nuria silvia susana inés alba irene sofía valentina camila ximena guadalupe esperanza consuelo soledad",
    "joão paulo tiago nuno rui vasco duarte afonso gonçalo luís marcelo rodrigo thiago caio gustavo leandro wagner joana mariana catarina fernanda juliana larissa letícia luana beatriz bruna giovanna giuseppe giovanni luigi mario francesco roberto paolo luca marco andrea matteo lorenzo alessandro stefano davide simone fabio massimo enrico pietro salvatore vincenzo giorgio riccardo dario elio giulia chiara francesca valentina federica alessia martina sara elisa paola giovanna lucia rosa bianca ginevra beatrice caterina ornella",
    # Slavic, Baltic, Hungarian, Romanian, Greek
    "ivan dmitri dmitry sergei sergey alexei alexey mikhail nikolai vladimir igor oleg pavel yuri boris viktor anatoly konstantin maxim artem kirill roman denis andrei stanislav bohdan taras mykola oleksandr ostap olga natalia irina svetlana tatiana elena anastasia ekaterina marina galina ludmila oksana yulia daria polina ksenia vera nadia nadezhda zoya raisa larisa yelena halyna iryna jan piotr andrzej krzysztof tomasz paweł marcin michał jakub mateusz wojciech zbigniew ryszard jerzy tadeusz stanisław łukasz grzegorz kamil bartosz anna maria katarzyna małgorzata agnieszka barbara ewa krystyna elżbieta zofia magdalena joanna aleksandra monika danuta",
    "jiří václav zdeněk petr milan miroslav jaroslav lubomír radek vít jana hana lenka kateřina markéta marek juraj matej zuzana dragan zoran goran nikola stefan miloš jelena milica snežana vesna ivana luka anton tomaž matjaž ferenc lászló istván zoltán attila balázs gábor ágnes katalin ildikó ion mihai andrei cristian bogdan vlad radu ioana elena simona georgi dimitar plamen yordan desislava giorgos nikos dimitris yannis kostas stavros eleni katerina sofia maria despina jonas tomas mindaugas rasa janis andris ilze kristjan tõnu",
    # Arabic, Turkish, Persian, Hebrew
    "mohammed muhammad mohamed ahmed ali hassan hussein omar yusuf youssef ibrahim khalid abdullah mustafa mahmoud karim tariq samir rashid faisal bilal hamza zaid jamal nasser walid fatima aisha khadija zainab maryam layla leila noor amina salma yasmin samira rania huda nadia farah hana dina mona mehmet mustafa hüseyin hasan ismail osman murat emre burak cem kemal orhan serkan tolga ayşe emine hatice zeynep elif merve esra selin defne yasemin reza hossein mehdi amir arash dariush farhad kaveh parisa shirin nasrin maryam avraham yitzhak moshe shlomo noa tamar rivka yael shira eitan",
    # South Asian
    "rahul amit sanjay rajesh vijay ravi suresh ramesh anil sunil ashok deepak manoj vikram arjun rohan aditya karthik harish ganesh krishna mohan prakash naveen pradeep nikhil siddharth varun abhishek ankit gaurav priya priyanka anjali pooja neha kavita sunita anita meena lakshmi divya shreya swati ritu nisha rekha asha usha radha sita geeta aparna deepika kiran jyoti imran salman farhan zubair shahid asif nadeem sana hina bushra ayesha nasreen arif rafiq",
    # East and Southeast Asian
    "wei ming li jun hao yang lei tao bin peng xin yan ling mei fang ying xiu hong yu jing hui min hiroshi takashi kenji haruto sota yuki kaito daisuke takumi naoki satoshi akira makoto hideo sakura yui aoi hina mio akiko keiko yoko tomoko naomi emi haruka minjun seojun jiho jihoon minho sungmin hyun jiwoo seoyeon jiyoung eunji minji soojin nguyen minh anh linh huong thao tuan dung phuong budi agus siti dewi putri wayan ketut ratna rizky somchai somsak malee juan jose andres maricel jomar",
    # African
    "kwame kofi kojo yaw ama akua abena efua chinedu emeka ifeanyi obinna chukwuma ngozi chioma nkechi amaka adaeze ifeoma oluwaseun babatunde tunde femi segun folake yetunde bola temitope amadou mamadou ousmane ibrahima fatou aminata mariama awa tendai tafadzwa farai rudo chipo thabo sipho themba bongani nomsa thandiwe lerato zanele kipchoge kamau wanjiru njeri wambui achieng otieno juma zawadi amani baraka haile tesfaye abebe almaz tigist selam dawit yonas",
    # Cyrillic and Greek spelling
    "иван дмитрий сергей алексей михаил николай владимир игорь олег павел юрий борис виктор анна мария ольга наталья ирина светлана татьяна елена анастасия екатерина марина γιώργος νίκος μαρία ελένη κώστας",
)
SURNAME = _words(
    "smith jones williams brown taylor davies evans thomas johnson wilson roberts robinson wright thompson white hughes edwards green hall wood harris lewis martin jackson clarke turner hill scott cooper morris ward moore clark lee king baker harrison morgan allen james parker phillips watson davis bennett price griffiths young adams mitchell cook carter richardson bailey collins bell shaw murphy miller cox marshall simpson anderson ellis chapman foster hunter mason gray grant palmer rogers stevens webb powell barnes fisher henderson gibson hamilton graham reynolds wallace stone sullivan kennedy obama thatcher churchill lincoln washington jefferson roosevelt nixon reagan clinton bush trump biden o'brien o'connor o'neill mcdonald mckenzie macleod fitzgerald gallagher doyle byrne walsh",
    "müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann schäfer koch bauer richter klein wolf schröder neumann schwarz zimmermann braun krüger hofmann hartmann lange schmitt werner krause meier lehmann schmid schulze maier köhler herrmann könig walter mayer huber kaiser fuchs peters lang scholz möller weiß jung hahn schubert vogel friedrich keller günther frank berger winkler roth beck lorenz baumann franke albrecht schuster simon ludwig böhm winter kraus martin schumacher krämer vogt stein jäger otto sommer groß seidel heinrich brandt haas schreiber graf schulte dietrich ziegler kuhn kühn pohl engel horn busch bergmann thomas voigt sauer arnold wolff pfeiffer schäuble merkel kohl brandt",
    "janssen devries jansen bakker visser smit meijer deboer mulder bos vos peters hendriks dekker brouwer dijkstra andersson johansson karlsson nilsson eriksson larsson olsson persson svensson gustafsson lindberg lindström bergström lundgren hansen olsen larsen andersen pedersen nilsen kristiansen jensen nielsen christensen rasmussen sørensen jørgensen korhonen virtanen mäkinen nieminen",
    "bernard dubois durand moreau laurent lefebvre leroy roux david bertrand morel fournier girard bonnet dupont lambert fontaine rousseau vincent muller lefevre faure andre mercier blanc guerin boyer garnier chevalier francois legrand gauthier garcia perrin robin clement morin nicolas henry roussel mathieu gautier masson marchand duval denis dumont marie lemaire noel meyer dufour meunier brun blanchard giraud joly riviere lucas brunet gaillard barbier arnaud martinez gerard roche renard schmitt roy leroux colin vidal caron picard macron sarkozy mitterrand",
    "garcía rodríguez gonzález fernández lópez martínez sánchez pérez gómez jiménez ruiz hernández díaz moreno muñoz álvarez romero alonso gutiérrez navarro torres domínguez vázquez ramos gil ramírez serrano blanco molina morales suárez ortega delgado castro ortiz rubio marín sanz núñez iglesias medina garrido cortés castillo santos lozano guerrero cano prieto méndez cruz calvo gallego vidal león márquez herrera peña flores cabrera campos vega fuentes carrasco diez reyes caballero nieto aguilar pascual santana herrero lorenzo hidalgo montero ibáñez giménez ferrer duran silva santos ferreira pereira oliveira costa rodrigues martins sousa fernandes gonçalves gomes lopes marques alves almeida ribeiro pinto carvalho teixeira moreira correia mendes nunes soares vieira monteiro cardoso rocha raposo neves coelho cruz cunha pires ramos reis simões antunes",
    "rossi russo ferrari esposito bianchi romano colombo ricci marino greco bruno gallo conti deluca mancini costa giordano rizzo lombardi moretti barbieri fontana santoro mariani rinaldi caruso ferrara galli martini leone longo gentile martinelli vitale lombardo serra coppola desantis marchetti parisi villa conte ferraro ferri fabbri bianco marini grasso valentini messina",
    "ivanov smirnov kuznetsov popov vasiliev petrov sokolov mikhailov novikov fedorov morozov volkov alekseev lebedev semenov egorov pavlov kozlov stepanov nikolaev orlov andreev makarov nikitin zakharov shevchenko kovalenko bondarenko tkachenko kravchenko oliynyk melnyk shevchuk koval polishchuk nowak kowalski wiśniewski wójcik kowalczyk kamiński lewandowski zieliński szymański woźniak dąbrowski kozłowski jankowski mazur kwiatkowski krawczyk novák svoboda novotný dvořák černý procházka kučera veselý horák němec horvat kovačević babić marić jurić petrović jovanović nikolić marković đorđević stojanović popescu ionescu popa radu dumitru stan stoica gheorghe nagy kovács tóth szabó horváth varga kiss molnár papadopoulos georgiou nikolaidis иванов петров смирнов кузнецов попов соколов иванова петрова",
    "yılmaz kaya demir şahin çelik yıldız yıldırım öztürk aydın özdemir arslan doğan kılıç aslan çetin kara koç kurt özkan şimşek hussain khan ahmed ali malik shah sheikh mahmood iqbal chaudhry butt mirza qureshi hashemi ahmadi mohammadi rezaei karimi mousavi cohen levy mizrahi peretz biton dahan avraham friedman katz haddad khoury mansour nasser saleh hamdan",
    "sharma verma gupta singh kumar patel shah mehta reddy rao nair menon iyer iyengar mukherjee chatterjee banerjee ganguly das ghosh bose sen roy chowdhury dutta sarkar mishra pandey tiwari dubey yadav chauhan joshi kulkarni deshpande patil pawar jadhav kapoor khanna malhotra chopra bhatia arora sethi agarwal bansal goel mittal jain desai trivedi naidu pillai krishnan subramanian raghavan perera fernando silva rahman islam hossain uddin",
    "wang li zhang liu chen yang huang zhao wu zhou xu sun ma zhu hu guo he lin luo gao zheng liang xie tang song deng han feng cao peng zeng xiao tian dong pan yuan cai jiang yu du ye cheng su wei lu ding ren shen yao sato suzuki takahashi tanaka watanabe ito yamamoto nakamura kobayashi kato yoshida yamada sasaki yamaguchi matsumoto inoue kimura hayashi shimizu yamazaki mori abe ikeda hashimoto yamashita ishikawa nakajima maeda fujita ogawa goto okada hasegawa kim park choi jeong kang cho yoon jang lim shin seo kwon hwang ahn song hong nguyen tran le pham hoang phan vu vo dang bui do ho ngo duong santos reyes cruz bautista ocampo",
    "okafor okonkwo eze nwosu obi adeyemi adebayo ogunleye balogun abubakar bello musa ibrahim mensah owusu boateng asante osei appiah acheampong diallo traore keita coulibaly diop ndiaye fall sow ba kone toure cisse mwangi kamau njoroge otieno ochieng odhiambo wanjiku kimani mutua dlamini nkosi ndlovu khumalo mkhize zulu mokoena molefe tesfaye bekele alemu girma tadesse mandela",
)
SURNAME_ENDINGS = (
    "enko", "chuk", "ov", "ova", "ev", "eva", "sky", "ski", "ska", "cki", "wicz", "vić", "ić", "vich", "son", "sson", "sen", "sohn", "mann", "berg", "burg", "stein", "feld", "bauer", "maier", "meyer", "bach", "wald", "thal", "quist", "qvist", "ström", "gren", "lund", "dahl", "vik", "stad", "ez", "es", "az", "iz",
    "etti", "elli", "ini", "ino", "one", "ucci", "aldi", "escu", "eanu", "oglu", "ian", "yan", "dze", "shvili", "idis", "akis", "opoulos", "ides", "wala", "kar", "jee", "rajan", "swamy", "moto", "mura", "gawa", "shima", "yama", "saki", "eau", "eaux", "ault", "ard", "aud", "ot", "et",
    "ton", "ham", "ley", "ford", "worth", "well", "wick", "bury", "shaw", "croft", "man", "kins", "ings", "ridge", "combe", "thorpe", "by", "ner", "ler", "zer", "ck", "tz", "ов", "ова", "ев", "ева", "ин", "ина", "ский", "ская", "ко", "ук", "ич", "όπουλος", "ίδης", "άκης",
)
PLACE = _words(
    "america europe asia africa australia canada mexico brazil argentina chile peru colombia spain portugal france germany italy austria switzerland belgium netherlands holland luxembourg denmark norway sweden finland iceland ireland england scotland wales britain poland hungary romania bulgaria greece turkey ukraine russia china japan korea india pakistan bangladesh nepal vietnam thailand indonesia malaysia singapore philippines egypt morocco kenya nigeria ghana ethiopia israel jordan lebanon syria iraq iran arabia qatar emirates zealand zealander kingdom states york london paris berlin madrid rome milan vienna zurich geneva brussels amsterdam dublin edinburgh glasgow manchester liverpool birmingham leeds bristol oxford cambridge boston chicago houston dallas austin denver seattle portland phoenix atlanta miami orlando detroit angeles francisco diego vegas orleans jersey hampshire california texas florida virginia carolina georgia dakota montana nevada oregon toronto vancouver montreal sydney melbourne tokyo osaka kyoto beijing shanghai delhi mumbai bangalore moscow warsaw prague budapest athens istanbul cairo lagos nairobi munich hamburg frankfurt cologne stuttgart lyon marseille bordeaux lisbon porto barcelona valencia sevilla deutschland österreich schweiz frankreich españa italia"
)
ORDINARY = _words(
    # function words and openings, several languages
    "the a an this that these those there here it its he she they we you i me him her them us my your his our their who what which when where why how and or but if so then than as at by for from in into of off on onto out over to under up upon with without within after before about above below between during since until while is are was were be been being am has have had do does did will would shall should can could may might must not no yes all any each every both few many more most other some such only own same too very just now also please thanks thank dear hello hi hey regards sincerely best kind warm cheers mr mrs ms miss dr prof sir madam note notes re fwd cc bcc ps attn subject date from to",
    "der die das den dem des ein eine einen einem einer und oder aber wenn weil dass ist sind war waren wird werden wurde hat haben hatte ich du er sie es wir ihr mich dich sich mein dein sein unser euer nicht kein keine auch nur noch schon sehr bitte danke hallo guten morgen tag abend liebe lieber sehr geehrte geehrter herr frau mit von vom zu zum zur bei nach aus für über unter vor hinter neben zwischen durch gegen ohne um im in am an auf",
    "le la les un une des du de au aux et ou mais si ce cet cette ces mon ma mes ton ta tes son sa ses notre votre leur nous vous ils elles il elle je tu on est sont était été avoir être pour par sur sous dans avec sans chez entre vers bonjour merci monsieur madame mademoiselle cher chère el los las una unos unas del al y o pero si este esta estos estas mi tu su nuestro vuestro es son fue era por para con sin sobre entre hasta desde hola gracias señor señora estimado estimada il lo gli uno ed ma se questo questa mio tuo suo nostro è sono con senza per tra fra ciao grazie signor signora gentile o os as um uma e ou mas este esta meu seu nosso com sem por para olá obrigado senhor senhora prezado het een en van voor met op",
    # months, days, numbers, directions, colours
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag janvier février mars avril juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo one two three four five six seven eight nine ten first second third fourth last next north south east west northern southern eastern western upper lower left right centre center middle red blue green yellow white black grey gray brown orange purple pink silver gold golden dark light bright",
    # seasons, nature, places
    "spring summer autumn fall winter season morning noon evening night day week month quarter year today tomorrow yesterday holiday easter christmas river lake sea ocean mountain hill valley forest wood woods park garden gardens field meadow beach coast island bay harbour harbor port cape desert rock stone sand rain snow ice wind storm sun moon star sky cloud fire water earth air tree flower rose leaf bird lion tiger eagle bear wolf fox horse dog cat fish bridge tower castle palace church temple cathedral museum library theatre theater cinema station airport terminal platform gate tunnel dock quay pier wharf market mall plaza square street road avenue lane drive court way place path trail row close crescent terrace boulevard highway motorway junction corner district borough county region province state country city town village suburb capital border zone area site spot",
    # business and office
    "account accounts accounting action active activity address admin administration advance advert advice agency agenda agent agreement alert amount analysis analytics annual answer application apply appointment approval approved archive article asset assistance assistant association attention audit authority auto automatic average award back balance bank banking basic basket batch benefit bill billing board body bonus book booking box branch brand break brief budget building business button buyer cable calendar call campaign cancel capacity card care cargo carrier case cash catalog category certificate chain chair chairman change channel chapter charge chart chat check checkout chief choice claim class classic clean clear client close closed club code collect collection college comment commerce commercial commission committee common community company complete compliance component conference confirm confirmation connect connection contact content contract control cookie copy core corporate corporation correction cost council count counter coupon course courier court cover create credit crew critical current customer customs cycle daily damage dashboard data database deadline deal dealer debit debt decision default delay deliver delivery demand demo department deposit depot design desk detail details development device digital direct direction director discount dispatch display distribution division document domain domestic door double download draft driver duty early edition editor education effect email emergency employee employer empty end energy engine engineer engineering enquiry entry environment equipment error estate estimate event exchange executive exit expense expert export express extension external extra facility factory failed failure fair family fashion fast fee feedback field figure file final finance financial fine fire firm fitness fixed flag fleet flight floor flow folder follow food force foreign form format forward foundation frame framework free freight fresh front fuel full function fund future gallery gap gas general gift global good goods government grace grade grand grant great gross ground group growth guarantee guard guest guide half hall hand handling happy hardware head headquarters health heavy help high history hold home hospital host hotel hour house housing human idea identity image impact import important income incident index individual industrial industry info information initial inquiry inspection institute insurance interest internal international internet interview inventory investment invoice issue item job joint journal key kitchen label labor labour lab language large late law leader learning lease leave legal letter level license life limit limited line link list live load loan local location lock log logic login logistics long lost loyalty machine mail main maintenance major management manager manual map mark marketing master material matter medical medicine meeting member memory menu merchant message metal meter method metro minimum minor minute mission mobile model modern module money monitor month motor move movie multi music name national natural network new news normal notice notification number nurse offer office officer official old online open operation operations operator option order ordinary organic organization origin original outlet output overnight overview owner package packaging packet page paid pallet panel paper parcel parent part partner party pass passport password past patch patient pattern pause pay payment payroll peak pending people percent performance period permit personal personnel phase phone photo pick picture piece pilot pipeline plan planning plant plate platform play plus point police policy pool popular position post postal power practice premium press price primary prime print printer prior priority private prize problem process processing product production profile profit program programme progress project promo promotion proof property protection provider public purchase quality quantity query question queue quick quota quote radio rail railway range rapid rate ratio raw reach read reader ready real reason receipt receive received receiver reception record recovery reference refund register registration regular reject release reliable remote rent rental repair repeat reply report request rescue research reserve reset resource response restaurant result retail retry return returns revenue review reward ride ring risk role roll room root round route router royal rule run safe safety salary sale sales sample scan scanner schedule school science scope screen script search seat section sector secure security select self sell seller send sender senior sensor serial series server service services session set setting settings setup shared sheet shelf shift ship shipment shipping shop shopping short show side sign signal signature silver simple single size skill slot slow small smart social software solution sort sound source space spare special speed sport staff stage standard star start statement status step stock stop storage store story strategy stream strong student studio study style subject submit subscription success summary super supplier supply support survey switch system table tag target task tax team tech technical technology telephone television template term test text theory ticket tile time tip title token tool top total tour track tracking trade traffic train trainer training transaction transfer transit transport travel tray trial trip truck true trust type union unit universal university unknown update upgrade upload urgent usage use user valid value van variable vehicle vendor venue verified version victim video view visa visit visitor voice volume voucher wait wall warehouse warning warranty waste watch wave web website weekly weight welcome wheel wholesale wide window wire wireless word work worker workshop world wrap yard young zero zip",
    # technology names and terms
    "android apple windows linux mac macos os ios unix ubuntu chrome chromium firefox mozilla safari webkit gecko opera edge explorer internet google microsoft amazon facebook twitter youtube github gitlab docker kubernetes oracle java javascript python ruby rust node react angular django rails spring boot http https html css json xml yaml sql rest soap grpc graphql api sdk url uri uuid guid id ssl tls tcp udp dns ip vpn cpu gpu ram rom usb pdf csv zip gzip utf ascii agent accept bearer basic content type length host origin referer cache control cookie token session trace span request response client server proxy gateway cluster pod namespace node shard replica bucket lambda kernel driver firmware build release debug beta alpha stable nightly like khtml mobile tablet desktop iphone ipad intel amd arm nvidia",
    # verbs and adjectives that open sentences
    "add ask allow assign begin bring build buy came choose come consider contact continue could customer deliver discuss download enter expect explain feel find follow get give go got great happen hear hope include inform join keep know learn leave let look lost made make mean meet moved need notify offer order pay pick picked provide put raise reached receive remember remove replace requested reserve resend return said saw say see seems send sent should show signed sorry speak spoke start stay stopped suggest take talk tell think told took tried try turn unable update urgent use verify visit wait want watch went write wrote written alternative available better big broken cheap correct damaged different difficult easy empty excellent false friendly full funny heavy hidden hot incomplete incorrect incredible lucky missing modern narrow nice perfect poor possible pretty proper quick quiet rare recent rich rough sad sharp silent slow soft solid special strange sweet tall thick thin tiny useful usual warm weak wet wild wonderful wrong",
    # German, French, Spanish nouns and adjectives
    "anfrage angebot anruf antwort artikel auftrag bestellung betrag brief büro datum dienst eingang empfänger fehler firma gerät geschäft gebäude grund haus hilfe hof information kasse karte konto kunde kundin kunden lager land lieferung liste mail meldung menge monat nachricht name nummer ort paket palette post preis problem projekt rechnung rückgabe rückruf schaden seite sendung service stadt stelle straße stunde system teil telefon termin tor uhr unterlagen unterschrift verkauf versand vertrag vorgang ware weg woche zahlung zeit zentrum zimmer zugang neue neuer neues alte alter große großer kleine gute guter schöne erste letzte nächste",
    "adresse agence appel article avis bon bureau carte chef client cliente colis commande compte contrat courrier date demande dépôt entrée entreprise erreur facture fichier gare grand grande heure jour jardin lettre ligne liste livraison livreur magasin marché message ministre mois montant mot nom nouveau nouvelle numéro objet paiement palette petit petite porte prix problème produit quai quantité reçu remise retour rue semaine service société suivi ticket ville votre voiture almacén artículo aviso caja calle cantidad carta casa centro ciudad cliente código compra correo cuenta dirección edificio empresa entrega entregar envío error factura fecha gran hora lista llamada llave lugar mañana mensaje mercado mes nombre nuevo nueva número oficina pago paquete pedido plaza precio primero primera producto puerta recibo recibido semana servicio tarde tienda total",
    # titles of works, groups and offices
    "academy act agency alliance army awards brothers cabinet championship chronicle coalition company congress constitution convention crown cup daily department empire federation festival games gazette guardian herald institute journal league magazine minister ministry movement navy observer olympics opera orchestra parliament party post president prime prince princess prize queen republic review royal senate society sons space standard star times treaty trophy tribune united war weekly world",
)
ORDINARY_ENDINGS = (
    "tion", "sion", "ment", "ness", "ship", "hood", "able", "ible", "ity", "ance", "ence", "ency", "ancy", "ing", "ings", "ism", "ology", "ware", "ward", "wards", "wise", "less", "ful", "ous", "ive", "ical", "ally", "ated", "ized", "ised", "ung", "ungen", "heit", "keit", "schaft", "lich", "ische", "tät", "ité", "eur", "euse", "ción", "dad", "miento", "aje", "zione", "mento", "ação", "ers", "ies",
)


def classify(word: str, hidden: bool = False) -> str:
    """One letter for a word: g given name, s surname, x and y these and an ordinary word as well, e and q an ending of surnames and of ordinary words, o ordinary, p place, u none of these. ``hidden`` looks at endings only."""
    low = unicodedata.normalize("NFC", word.lower().replace("’", "'"))
    if not hidden:
        ordinary, place = low in ORDINARY, low in PLACE
        if low in GIVEN:
            return "x" if ordinary or place else "g"
        if low in SURNAME:
            return "y" if ordinary or place else "s"
        if ordinary:
            return "o"
        if place:
            return "p"
        if "-" in low or "‐" in low:
            parts = {classify(p) for p in low.replace("‐", "-").split("-") if p}
            return next((c for c in "gseuxyqop" if c in parts), "u")
        if low.endswith(("'s", "s'")) and low.rstrip("s").rstrip("'") in ORDINARY | PLACE:
            return "o"
        for end in ("s", "es", "en", "er", "e", "ed", "d", "ly", "n"):
            if len(low) > len(end) + 4 and low.endswith(end) and low[: -len(end)] in ORDINARY:
                return "o"
    if len(low) > 5 and low.endswith(ORDINARY_ENDINGS):
        return "q"
    return "e" if len(low) > 4 and low.endswith(SURNAME_ENDINGS) else "u"
