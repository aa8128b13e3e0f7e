"""The small labelled table the model of personal details is trained from.

Sentences of letters, forms, notices, small ads and minutes, with typed slots
that rules fill from common names, syllables and number forms, with a fixed
seed. The sentences were made up for this table. It isn't independent of the
test data, though: kinds of sentences, decoy nouns and number forms were added
after looking at what the model missed or found too much in stored texts.
"""

from __future__ import annotations

import random
import re
import unicodedata

# Widespread first names, old and new.
FIRST = {
    "fr": "Adrien Agathe Agnès Aimé Alain Albert Alexandre Alice Aline Amélie Anaïs André Anne Antoine Apolline Armand Arthur Aurélie Aurore Baptiste Bastien Béatrice Benoît Bérénice Bernard Blanche Bruno Camille Capucine Cécile Céline Charles Charlotte Chloé Christian Christophe Claire Claude Clément Clémence Clotilde Colette Coralie Cyril Damien Daniel Delphine Denis Didier Dominique Édith Édouard Éléonore Élise Élodie Éloïse Émile Émilie Emma Éric Estelle Étienne Eugène Fabien Fabrice Fanny Florence Florian Francis François Françoise Gabriel Gaël Gaspard Geneviève Georges Gérard Gilles Grégoire Guillaume Guy Hélène Henri Hervé Hubert Hugo Inès Irène Isabelle Jacques Jean Jeanne Jérôme Joël Juliette Justine Laure Laurent Léa Léon Loïc Louis Louise Lucas Lucie Luc Madeleine Maël Manon Marc Margaux Marguerite Marie Marion Martine Mathieu Mathilde Maurice Maxime Mélanie Michel Monique Nathalie Nicolas Noël Noémie Odette Olivier Pascal Patrick Paul Paulette Philippe Pierre Quentin Raphaël Raymond Rémi Renée René Robert Roger Roland Romain Sabine Sandrine Sébastien Serge Simone Solange Sophie Stéphane Suzanne Sylvain Sylvie Tanguy Théo Théodore Thérèse Thibault Thierry Thomas Tristan Valentin Valérie Vincent Virginie Xavier Yann Yves Yvonne Zoé",
    "en": "Adam Agnes Aisha Alan Albert Alexander Alice Amanda Amy Andrew Angela Ann Anthony Arthur Audrey Barbara Beatrice Benjamin Bernard Betty Brian Bridget Carol Catherine Charles Charlotte Christine Christopher Clare Clive Colin Cynthia Daniel Daphne David Dawn Deborah Denise Dennis Derek Deshawn Donald Donna Doris Dorothy Douglas Duncan Edith Edward Eileen Eleanor Elizabeth Ellen Emily Emma Eric Ernest Ethel Eugene Evelyn Florence Frances Francis Frank Fred Geoffrey George Gerald Gillian Gladys Gordon Grace Graham Gregory Hannah Harold Harry Hazel Heather Helen Henry Hilda Howard Hugh Ian Irene Jack Jacqueline James Jane Janet Jason Jean Jennifer Jessica Joan John Jonathan Joseph Joshua Joyce Judith Julia Karen Kathleen Keith Kenneth Kevin Laura Lawrence Leonard Leslie Lillian Linda Lisa Lucy Malcolm Margaret Maria Marion Mark Martin Mary Matthew Maureen Melissa Michael Mildred Nancy Neil Nicholas Nigel Norman Olive Oliver Oscar Pamela Patricia Paul Peter Philip Phyllis Priya Quentin Rachel Ralph Raymond Rebecca Richard Robert Robin Roger Ronald Rose Roy Ruth Samuel Sandra Sarah Sean Sheila Sidney Simon Stanley Stella Stephen Steven Stuart Susan Sylvia Theresa Thomas Timothy Tracy Trevor Vera Victor Victoria Vincent Violet Virginia Walter Wei Wendy William Winifred",
    "de": "Achim Adelheid Albert Alexander Andrea Andreas Angelika Anja Anke Anna Anton Astrid August Axel Barbara Beate Bernd Bernhard Birgit Björn Brigitte Carsten Christa Christian Christine Claudia Cornelia Daniel Detlef Dieter Dirk Doris Eberhard Edith Elfriede Elisabeth Elke Ella Emil Erich Erika Ernst Erwin Eva Felix Florian Frank Franz Frieda Friedrich Fritz Gabriele Georg Gerd Gerhard Gertrud Gisela Gottfried Greta Gudrun Gustav Hannelore Hans Harald Hartmut Heidi Heike Heinrich Heinz Helga Helmut Herbert Hermann Hilde Holger Horst Hubert Ilse Ingeborg Ingrid Irmgard Jakob Jan Jana Joachim Johanna Johannes Jonas Josef Jörg Julia Jürgen Jutta Kai Karin Karl Karsten Katharina Katrin Kerstin Klara Klaus Konrad Kurt Lars Lena Leon Leonie Liesel Lina Lothar Ludwig Luise Lukas Manfred Margarete Maria Markus Marlene Martha Martin Martina Mathilde Matthias Max Michael Mia Monika Nicole Nora Norbert Olaf Oskar Otto Paul Paula Peter Petra Ralf Regina Reiner Reinhard Renate Richard Robert Roland Rolf Rosemarie Rudolf Ruth Sabine Sandra Silke Simone Sonja Sophie Stefan Stefanie Susanne Sven Thea Theodor Thomas Torsten Udo Ulrich Ursula Ute Uwe Vera Viktor Volker Waltraud Walter Werner Wilhelm Wilma Wolfgang",
    "es": "Adela Adrián Agustín Alba Alberto Alejandro Alfonso Alfredo Alicia Almudena Álvaro Amparo Ana Andrea Andrés Ángel Ángeles Antonia Antonio Arturo Asunción Aurora Beatriz Belén Benito Bernardo Blanca Carlos Carmen Carolina Catalina Cecilia César Clara Claudia Concepción Consuelo Cristina Cristóbal Daniel David Diana Diego Dolores Domingo Eduardo Elena Elisa Elvira Emilio Enrique Ernesto Esperanza Esteban Esther Eugenia Eva Federico Felipe Felisa Félix Fernando Francisca Francisco Gabriel Gloria Gonzalo Gregorio Guadalupe Guillermo Héctor Hugo Ignacio Inés Irene Isabel Ismael Iván Jaime Javier Jesús Joaquín Jorge José Josefa Juan Juana Julia Julio Laura Leonor Lidia Lorena Lorenzo Lourdes Lucas Lucía Luis Luisa Manuel Manuela Marcos Margarita María Mariano Marina Mario Marta Martín Mateo Mercedes Miguel Milagros Mónica Montserrat Natalia Nicolás Nieves Noelia Nuria Óscar Pablo Paloma Patricia Paula Pedro Pilar Rafael Ramón Raquel Raúl Remedios Ricardo Rita Roberto Rocío Rodrigo Rosa Rosario Rubén Salvador Samuel Santiago Sara Sergio Silvia Simón Sofía Soledad Sonia Susana Teresa Tomás Valentín Verónica Vicente Víctor Virginia Yolanda",
    "it": "Agnese Alberto Aldo Alessandro Alessia Alfredo Alice Andrea Angela Angelo Anna Antonella Antonio Arianna Beatrice Bruno Camilla Carla Carlo Carmela Caterina Cecilia Chiara Cinzia Claudio Cristina Daniela Dario Davide Domenico Donatella Edoardo Elena Eleonora Elisa Emanuele Emilia Enrico Ernesto Fabio Fabrizio Federica Federico Filippo Flavia Francesca Francesco Franco Gabriele Gaia Gianluca Gianni Giorgio Giovanna Giovanni Giulia Giulio Giuseppe Grazia Guido Ilaria Irene Jacopo Laura Lorenzo Luca Lucia Luciano Luigi Marcello Marco Margherita Maria Mario Marta Martina Massimo Matteo Maurizio Michele Monica Nadia Nicola Nicoletta Paola Paolo Patrizia Piero Pietro Raffaele Riccardo Rita Roberta Roberto Rosa Salvatore Sara Sergio Silvia Simona Sofia Stefania Stefano Teresa Tommaso Valentina Valeria Vincenzo Vittoria",
    "pt": "Adriana Afonso Alberto Alexandre Alice Álvaro Amélia Ana André Ângela António Artur Augusto Beatriz Bernardo Bruno Carla Carlos Carolina Catarina Cecília César Clara Cláudia Conceição Cristina Daniel David Diana Diogo Dulce Duarte Eduardo Elisa Elsa Emília Fátima Fernanda Fernando Filipa Filipe Francisca Francisco Frederico Gabriel Gonçalo Graça Guilherme Helena Henrique Hugo Inês Irene Isabel Joana João Joaquim Jorge José Júlia Júlio Laura Leonor Lúcia Luís Luísa Lurdes Madalena Manuel Manuela Marco Margarida Maria Mariana Mário Marta Mateus Matilde Miguel Mónica Nuno Olga Paula Paulo Pedro Rafael Raquel Ricardo Rita Roberto Rodrigo Rosa Rui Sandra Sara Sérgio Sílvia Simão Sofia Sónia Susana Teresa Tiago Tomás Tomé Vasco Vera Vicente Vítor",
    "ru": "Александр Александра Алексей Алла Анастасия Анатолий Андрей Анна Антон Борис Вадим Валентина Валерий Василий Вера Виктор Виктория Виталий Владимир Галина Геннадий Георгий Григорий Дарья Денис Дмитрий Евгений Екатерина Елена Иван Игорь Ирина Кирилл Константин Ксения Лариса Лев Леонид Любовь Людмила Максим Марина Мария Михаил Надежда Наталья Никита Николай Оксана Олег Ольга Павел Пётр Роман Светлана Семён Сергей Софья Степан Тамара Татьяна Фёдор Юлия Юрий Яков",
}
# Widespread family names.
LAST = {
    "fr": "Martin Bernard Dubois Thomas Robert Richard Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia Bertrand Roux Fournier Girard Bonnet Lambert Mercier Guérin Boyer Chevalier Faure Rousseau Blanc Perrin Clément",
    "en": "Smith Jones Williams Brown Taylor Davies Evans Wilson Johnson Roberts Thompson Wright Walker White Edwards Hughes Green Hall Lewis Harris Clarke Patel Jackson Wood Turner Cooper Hill Ward Morris O'Brien McDonald Whitfield",
    "de": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Schmitt Werner Krause Meier Lehmann",
    "es": "García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Álvarez Muñoz Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Ramos Gil Ramírez Serrano Blanco Molina",
    "it": "Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci Marino Greco Bruno Gallo Conti De Luca Mancini Costa Giordano Rizzo Lombardi Moretti D'Angelo",
    "pt": "Silva Santos Ferreira Pereira Oliveira Costa Rodrigues Martins Jesus Sousa Fernandes Gonçalves Gomes Lopes Marques Alves Almeida Ribeiro Pinto Carvalho",
    "ru": "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков Алексеев Лебедев Семёнов Егоров Павлов Козлов Степанов Николаев",
}
_ONSETS = "b br c ch d dr f fl g gl gr h j k l m n p ph pl pr r s sc st t th tr v vr w z".split()
_VOWELS = "a e i o u ai au ei ie oi ou é è â ï ö".split()
_ENDS = {
    "fr": "ac ard aud eau elle er et ette eux ier in ois on ot oux u y gny ville court mont bourg".split(),
    "en": "ing er man son ell ard ock ford ton ley wood field worth ham bridge stone by".split(),
    "de": "er mann ke el ling ich hardt bach berg stein feld hausen au ingen dorf heim".split(),
    "es": "ez o a ero ada illo ales ano edo uela ares ón iz era osa".split(),
    "it": "i o a ini etti elli ano aro one ucci ese acci".split(),
    "pt": "o a eira es inho al ães ote osa edo".split(),
    "ru": "ов ин ский ев енко ова ина ская".split(),
}
_RU = ["б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т"], "а е и о у я".split()

# {name}: a person, {last}: after a title; {addr}, {phone}, {email}, {id:...}: details.
# Decoys: {place}, {org}, {firm}, {street}, {who}: a name that something is called after; {ref}, {num}, {year}, {day}, {time}, {ver}, {ip}, {isbn}, {geo}, {price}.
TEMPLATES = {
    "fr": """
Voici mon numéro : {phone}.
Numéro à composer : {phone}
Écrivez à {email} ou composez le {phone}.
On peut le joindre le soir au {phone} ou le {phone}.
Une famille reçoit ce paquet chez M. {last}, {addr}.
Transmis par {name} le {day} mai.
Rapport rédigé par {name}, relu par {name}.
Un courrier a été envoyé à {name}.
Le menuisier {name} a remis son devis.
Une abonnée, {name}, signale une erreur.
La gagnante est {name}.
{name} s'est abstenu.
{name} ({email}) assure l'accueil.
Pour tout contact : {name}, {addr}, tél. {phone}
Coordonnées de {name} : {addr}, tél. {phone}, {email}.
Tél. {phone}, fax {phone}.
Affaire confiée à {name}, immatriculée {id:nir}.
L'assurée {name} (n° de sécurité sociale {id:nir}) conteste la décision.
Pour rejoindre l'équipe, téléphonez à {name} au {phone}.
Renseignements auprès de {name}, {phone}, ou par mail à {email}.
Merci d'adresser vos candidatures à {name}, {addr}.
Je soussigné {name}, demeurant {addr}, certifie sur l'honneur l'exactitude de ces données.
Je soussignée {name}, née à {place}, donne procuration à {name}.
Votre conseillère, Mme {last}, reste joignable au {phone}.
M. {last} a rappelé ce matin ; son portable est le {phone}.
Le docteur {last} reçoit au {addr}.
Me {last}, notaire, a lu l'acte devant Mlle {last}.
Cher Monsieur {last}, nous avons bien reçu votre courrier.
Cordialement, {name}
Bien à vous,
{name}
{phone}
Rédaction : {name}. Photographies : {name}.
Président : {name} ; trésorière : {name} ; secrétaire : {name}.
Étaient présents {name}, {name} et Mme {last}.
« Nous sommes ravis », confie {name}, la gérante.
« C'était mieux avant », soupire {name}, retraité de {place}.
{name} habite au {addr} depuis trente ans.
{name} a repris la boulangerie de {place} en {year}.
{name}, apiculteur, vend son miel sur le marché de {place}.
La comédienne {name} jouera le rôle principal.
Le maire, {name}, a coupé le ruban.
L'élève {name} a obtenu la meilleure note de sa classe.
Notre collègue {name} part à la retraite.
Livraison chez {name}, {addr}
Expéditeur : {name}, {addr}.
Adresse de facturation : {addr}
Le siège se trouve {addr}, et le standard répond au {phone}.
Nous déménageons : notez notre nouvelle adresse, {addr}.
Numéro de sécurité sociale : {id:nir}
Son numéro d'assuré est le {id:nir}.
NIR {id:nir}, affilié à la caisse de {place}.
Pièce d'identité présentée : carte nationale n° {id:card}.
Titulaire du passeport {id:pass}, {name} a embarqué à {place}.
Passeport numéro {id:pass} délivré par la préfecture de {place}.
Identifiant fiscal : {id:tax}.
N° fiscal de référence {id:tax} au nom de Mme {last}.
Fax : {phone}. Courriel : {email}.
Envoyez un message à {email} pour vous désinscrire.
Mobile {phone}, domicile {phone}.
Inscription auprès de la mairie de {place}, au {phone}.
La société {firm} a ouvert un dépôt à {place}.
Le groupe {firm} rachète {firm} et ses {num} salariés.
{org} organise une collecte à {place} le {day} mars {year}.
L'association {org} a reçu {price} de la région.
La fondation {who} finance la restauration de la chapelle de {place}.
Le collège {who} et l'école {who} partagent la cantine.
Rendez-vous devant la statue de la place {who}.
La salle {who} sera fermée le {day} avril.
Le stade {who} accueille {num} spectateurs.
L'hôpital {who} recrute {num} infirmières.
La bibliothèque {who} rouvre lundi.
Le prix {who} récompense un roman paru chez {firm}.
Travaux dans la rue {who} et l'avenue de {place} jusqu'au {day} juin.
Le train de {time} pour {place} est annoncé avec {num} minutes de retard.
Le roman « {place} la Rouge » se déroule à {place}.
Selon {firm}, la production de {place} a doublé entre {year} et {year}.
Le tribunal de {place} a débouté {org} de sa plainte.
La rivière {place} se jette dans le lac de {place}.
À {place}, le musée {place} expose {num} toiles de l'école de {place}.
Le navire {place} a quitté le port de {place} avec {num} tonnes de {place}.
Le logiciel {place} {ver} remplace {place}Soft.
Dossier {ref} du {day}/{day}/{year}, montant {price}.
Commande n° {ref}, total {price}, livraison sous {day} jours.
Numéro ISBN {isbn}, {num} pages, {price}.
Carte nationale d'identité n° {id:card} en cours de validité.
Carte d'identité {id:card} au nom de {name}, établie à {place}.
Permis de conduire et carte d'identité n° {id:card} à présenter.
M. {last} arrivera mardi.
Mme {last} et M. {last} sont absents.
M. {last}, directeur, a signé.
Selon M. {last}, tout est prêt.
Mlle {last} a demandé un délai.
On m'a donné rendez-vous {addr}.
Elle loge {addr}.
Il reçoit son courrier au {addr}, côté cour.
Position GPS : {geo}, {geo}.
Machine {ip}, port {num}, version {ver}.
Victoire {day}-{day} puis défaite {day}-{day} face à {place}.
Ouvert de {time} à {time}, fermé le dimanche.
Réf. client {ref}, contrat {ref}.
Article {day} du code, alinéa {day}, loi n° {year}-{num}.
Après une longue attente, le conseil municipal a tranché.
Pendant ce temps, les riverains de {place} préparent la fête.
Une visite guidée partira de la Tour {place} vers le Pont {place}.
""",
    "en": """
Here is my number: {phone}.
Number to dial: {phone}
Passed on by {name} on {day} May.
Report written by {name}, checked by {name}.
A letter was sent to {name}.
The joiner {name} handed in a quote.
A subscriber, {name}, points out a mistake.
The winner is {name}.
{name} abstained.
{name} ({email}) is at the front desk.
Get in touch: {name}, {addr}, phone {phone}
{name} of {addr} was asked.
They know {name} of {addr}, he said.
{name} can be found at {addr}, tel. {phone}, {email}.
Tel. {phone}, fax {phone}.
The claimant {name}, SSN {id:ssn}, objects.
Claim of {name}, social security number {id:ssn}.
For a viewing please ring {name} on {phone}.
Questions? Ask {name} ({email}) or dial {phone}.
Please send your application to {name}, {addr}.
I, {name}, of {addr}, hereby confirm the above.
The tenant, {name}, moved to {addr} last spring.
Your adviser Mr {last} can be reached on {phone}.
Mrs. {last} returned the call; her mobile is {phone}.
Dr. {last} sees patients at {addr}.
Ms. {last} and Prof. {last} signed for the college.
Dear Mr. {last}, thank you for your letter.
Kind regards, {name}
Yours sincerely,
{name}
{phone}
Words: {name}. Pictures: {name}.
Chair: {name}; treasurer: {name}; secretary: {name}.
Present were {name}, {name} and Mrs {last}.
“We are delighted,” said {name}, who owns the shop.
“It was better before,” {name} of {place} told us.
{name} has lived at {addr} for thirty years.
{name} took over the bakery in {place} in {year}.
{name}, a beekeeper, sells honey at {place} market.
The actress {name} will play the lead.
The mayor, {name}, cut the ribbon.
Pupil {name} had the best marks of the year.
Our colleague {name} is retiring.
Deliver to {name}, {addr}
Sender: {name}, {addr}.
Billing address: {addr}
The office is at {addr}, and the switchboard is {phone}.
We have moved; our new address is {addr}.
Social security number: {id:ssn}
Her SSN is {id:ssn}.
NI number {id:ssn}, paid in {place}.
Proof of identity: national card no. {id:card}.
Holder of passport {id:pass}, {name} flew from {place}.
Passport number {id:pass} was issued by the {place} office.
Taxpayer reference: {id:tax}.
Tax ID {id:tax} belongs to Ms {last}.
Fax: {phone}. Email: {email}.
Write to {email} to unsubscribe.
Mobile {phone}, home {phone}.
Register with the town hall of {place} on {phone}.
{firm} has opened a depot in {place}.
{firm} is buying {firm} and its {num} staff.
{org} runs a collection in {place} on {day} March {year}.
The {org} charity was given {price} by the county.
The {who} Foundation pays for the chapel at {place}.
{who} School and {who} College share a canteen.
Meet by the statue in {who} Square.
{who} Hall will be shut on {day} April.
The {who} Stadium seats {num}.
{who} Hospital is hiring {num} nurses.
The {who} Library reopens on Monday.
The {who} Prize goes to a novel published by {firm}.
Roadworks on {street} until {day} June.
{street} is closed to traffic.
The {time} train to {place} is running {num} minutes late.
The novel “The Red {place}” is set in {place}.
According to {firm}, output at {place} doubled between {year} and {year}.
The {place} court dismissed the claim of {org}.
The River {place} flows into Lake {place}.
In {place} the {place} Museum shows {num} canvases of the {place} school.
The ship {place} left {place} harbour with {num} tons of {place}.
{place} {ver} replaces {place}Soft.
File {ref} of {day}/{day}/{year}, amount {price}.
Order no. {ref}, total {price}, delivery within {day} days.
ISBN {isbn}, {num} pages, {price}.
GPS position: {geo}, {geo}.
Mr. {last} will come on Tuesday.
Mrs. {last} and Mr. {last} are away.
According to Mr {last} all is ready.
His social security number was {id:ssn}, she noted.
The national insurance number {id:ssn} is wrong.
Identity card {id:card} in the name of {name}, from {place}.
Driving licence and identity card no. {id:card} must be shown.
She stays at {addr}.
He gets his post at {addr}.
Machine {ip}, port {num}, release {ver}.
Won {day}-{day}, then lost {day}-{day} to {place}.
Open from {time} to {time}, closed on Sundays.
Customer ref. {ref}, contract {ref}.
Section {day}, paragraph {day} of the {year} Act.
After a long wait the town council decided.
Meanwhile residents of {place} prepare the fair.
A tour leaves {place} Tower for {place} Bridge.
Contact us via {addr}.
""",
    "de": """
Hier ist meine Nummer: {phone}.
Zu wählen ist die Nummer {phone}.
Weitergegeben von {name} am {day}. Mai.
Bericht verfasst von {name}, geprüft durch {name}.
Ein Brief ging an {name}.
Der Tischler {name} gab ein Angebot ab.
Eine Abonnentin, {name}, meldet einen Fehler.
Gewonnen hat {name}.
{name} enthielt sich.
{name} ({email}) sitzt am Empfang.
Ansprechpartner: {name}, {addr}, Tel. {phone}
{name} erreicht man in der {addr}, Telefon {phone}, {email}.
Tel. {phone}, Fax {phone}.
Antrag von {name}, Versicherungsnummer {id:nir}.
Steuer-Identifikationsnummer {id:tax} für {name}.
IdNr. {id:tax}, {name}.
Zur Besichtigung rufen Sie bitte {name} unter {phone} an.
Fragen beantwortet {name} ({email}, {phone}).
Bewerbungen bitte an {name}, {addr}.
Hiermit bestätige ich, {name}, wohnhaft {addr}, die Richtigkeit der Angaben.
Die Mieterin {name} ist in die {addr} gezogen.
Ihr Berater Herr {last} ist unter {phone} erreichbar.
Frau {last} hat zurückgerufen, ihre Handynummer lautet {phone}.
Dr. {last} hat seine Praxis in {addr}.
Prof. {last} und Frau {last} unterschrieben für das Kollegium.
Sehr geehrter Herr {last}, vielen Dank für Ihr Schreiben.
Mit freundlichen Grüßen {name}
Viele Grüße
{name}
{phone}
Text: {name}. Fotos: {name}.
Vorsitz: {name}; Kasse: {name}; Schriftführung: {name}.
Anwesend waren {name}, {name} und Frau {last}.
„Wir freuen uns sehr“, sagt {name}, die den Laden führt.
„Früher war es besser“, meint {name} aus {place}.
{name} wohnt seit dreißig Jahren in der {addr}.
{name} übernahm {year} die Bäckerei in {place}.
{name}, ein Imker, verkauft Honig auf dem Markt von {place}.
Die Schauspielerin {name} spielt die Hauptrolle.
Der Bürgermeister {name} durchschnitt das Band.
Die Schülerin {name} hatte die besten Noten.
Unser Kollege {name} geht in den Ruhestand.
Lieferung an {name}, {addr}
Absender: {name}, {addr}.
Rechnungsadresse: {addr}
Das Büro liegt {addr}, die Zentrale hat die Nummer {phone}.
Wir sind umgezogen, neue Anschrift: {addr}.
Sozialversicherungsnummer: {id:nir}
Ihre Rentenversicherungsnummer ist {id:nir}.
Ausweis Nr. {id:card} vorgelegt.
Inhaber des Reisepasses {id:pass} ist {name}.
Reisepass Nummer {id:pass}, Behörde {place}.
Steuernummer {id:tax} von Frau {last}.
Steueridentifikationsnummer: {id:tax}.
Fax: {phone}. E-Mail: {email}.
Abmelden per Nachricht an {email}.
Mobil {phone}, privat {phone}.
Anmeldung beim Rathaus {place} unter {phone}.
Die {firm} eröffnet ein Lager in {place}.
Die {firm} übernimmt die {firm} und deren {num} Angestellte.
Der Verein {org} sammelt am {day}. März {year} in {place}.
{org} erhielt {price} vom Kreis.
Die {who}-Stiftung bezahlt die Kapelle in {place}.
Die {who}-Schule und das {who}-Kolleg teilen sich die Mensa.
Treffpunkt am Denkmal auf dem {who}-Platz.
Die {who}-Halle bleibt am {day}. April zu.
Im {who}-Stadion sitzen {num} Zuschauer.
Das {who}-Krankenhaus stellt {num} Pfleger ein.
Der {who}-Preis geht an einen Roman aus dem Verlag {firm}.
Bauarbeiten in der {street} bis {day}. Juni.
Die {street} ist gesperrt.
Der Zug um {time} nach {place} hat {num} Minuten Verspätung.
Der Roman „Das rote {place}“ spielt in {place}.
Nach Angaben der {firm} hat sich die Menge in {place} von {year} bis {year} verdoppelt.
Das Gericht in {place} wies die Klage von {org} ab.
Der Fluss {place} mündet in den See bei {place}.
In {place} zeigt das Museum {place} {num} Bilder der Schule von {place}.
Das Schiff {place} verließ den Hafen {place} mit {num} Tonnen {place}.
Das Programm {place} {ver} ersetzt {place}Soft.
Akte {ref} vom {day}.{day}.{year}, Betrag {price}.
Bestellung Nr. {ref}, Summe {price}, Lieferung in {day} Tagen.
ISBN {isbn}, {num} Seiten, {price}.
GPS-Position: {geo}, {geo}.
Herr {last} kommt am Dienstag.
Frau {last} und Herr {last} fehlen.
Laut Herrn {last} ist alles bereit.
Personalausweisnummer {id:card}, gültig bis {year}.
Ausweis {id:card} auf den Namen {name}, Ort {place}.
Sie wohnt {addr}.
Er bekommt seine Post in der {addr}.
Rechner {ip}, Port {num}, Version {ver}.
Sieg {day}:{day}, dann Niederlage {day}-{day} gegen {place}.
Geöffnet von {time} bis {time} Uhr, sonntags zu.
Kundennummer {ref}, Vertrag {ref}.
Paragraf {day} Absatz {day} des Gesetzes von {year}.
Nach langem Warten hat der Stadtrat entschieden.
Unterdessen bereiten die Anwohner von {place} das Fest vor.
Eine Führung geht vom Turm {place} zur Brücke {place}.
""",
    "es": """
Este es mi número: {phone}.
Número al que llamar: {phone}
Enviado por {name} el {day} de mayo.
Informe escrito por {name}, revisado por {name}.
Se mandó una carta a {name}.
El carpintero {name} entregó su presupuesto.
Una abonada, {name}, avisa de un error.
La ganadora es {name}.
{name} se abstuvo.
{name} ({email}) atiende en recepción.
Persona de contacto: {name}, {addr}, tel. {phone}
{name} está en {addr}, teléfono {phone}, {email}.
Tel. {phone}, fax {phone}.
Solicitud de {name}, número de afiliación a la seguridad social {id:nir}.
Para concertar una visita, llame a {name} al {phone}.
Información: {name}, {phone}, o escriba a {email}.
Envíe su solicitud a {name}, {addr}.
Yo, {name}, con domicilio en {addr}, declaro que los datos son ciertos.
La inquilina, {name}, se mudó a {addr}.
Su asesor, el Sr. {last}, atiende en el {phone}.
La Sra. {last} devolvió la llamada; su móvil es el {phone}.
El Dr. {last} pasa consulta en {addr}.
La Dra. {last} y don {name} firmaron por el colegio.
Estimado Sr. {last}: gracias por su carta.
Un saludo, {name}
Atentamente,
{name}
{phone}
Texto: {name}. Fotos: {name}.
Presidenta: {name}; tesorero: {name}; secretaria: {name}.
Asistieron {name}, {name} y la Sra. {last}.
«Estamos encantados», dice {name}, dueña de la tienda.
«Antes era mejor», opina {name}, vecino de {place}.
{name} vive en {addr} desde hace treinta años.
{name} se hizo cargo de la panadería de {place} en {year}.
{name}, apicultor, vende miel en el mercado de {place}.
La actriz {name} hará el papel principal.
El alcalde, {name}, cortó la cinta.
La alumna {name} sacó la mejor nota.
Nuestro compañero {name} se jubila.
Entregar a {name}, {addr}
Remitente: {name}, {addr}.
Dirección de facturación: {addr}
La oficina está en {addr} y la centralita es el {phone}.
Nos hemos mudado: nueva dirección, {addr}.
Número de afiliación: {id:nir}
Su número de la Seguridad Social es {id:nir}.
Titular con DNI {id:dni}.
NIF {id:dni} de don {name}.
NIE: {id:dni}, concedido en {place}.
Titular del pasaporte {id:pass}, {name} voló desde {place}.
Pasaporte número {id:pass}, oficina de {place}.
Fax: {phone}. Correo: {email}.
Escriba a {email} para darse de baja.
Móvil {phone}, casa {phone}.
Inscripciones en el ayuntamiento de {place}, {phone}.
La empresa {firm} abre un almacén en {place}.
El grupo {firm} compra {firm} y sus {num} empleados.
{org} hace una colecta en {place} el {day} de marzo de {year}.
La asociación {org} recibió {price} de la provincia.
La fundación {who} paga la capilla de {place}.
El colegio {who} y la escuela {who} comparten comedor.
Quedamos junto a la estatua de la plaza {who}.
El salón {who} estará cerrado el {day} de abril.
El estadio {who} tiene {num} asientos.
El hospital {who} contrata a {num} enfermeras.
El premio {who} recae en una novela de la editorial {firm}.
Obras en la calle {who} y en la avenida de {place} hasta el {day} de junio.
El tren de las {time} a {place} lleva {num} minutos de retraso.
La novela «{place} la Roja» transcurre en {place}.
Según {firm}, la producción de {place} se duplicó entre {year} y {year}.
El juzgado de {place} rechazó la demanda de {org}.
El río {place} desemboca en el lago de {place}.
En {place}, el museo {place} muestra {num} lienzos de la escuela de {place}.
El barco {place} zarpó de {place} con {num} toneladas de {place}.
El programa {place} {ver} sustituye a {place}Soft.
Expediente {ref} del {day}/{day}/{year}, importe {price}.
Pedido n.º {ref}, total {price}, entrega en {day} días.
ISBN {isbn}, {num} páginas, {price}.
Posición GPS: {geo}, {geo}.
El Sr. {last} llega el martes.
La Sra. {last} y el Sr. {last} no están.
Según el Sr. {last}, todo está listo.
Documento de identidad {id:dni} en vigor.
Ella se aloja en {addr}.
Recibe el correo en {addr}.
Equipo {ip}, puerto {num}, versión {ver}.
Ganó {day}-{day} y perdió {day}-{day} contra {place}.
Abierto de {time} a {time}, domingos cerrado.
Ref. de cliente {ref}, contrato {ref}.
Artículo {day}, apartado {day}, ley {num}/{year}.
Tras una larga espera, el pleno decidió.
Mientras tanto, los vecinos de {place} preparan la feria.
""",
    "it": """
Scritto da {name}, riletto da {name}.
{name} si è astenuto.
Referente: {name}, {addr}, tel. {phone}
Per una visita chiamare {name} al {phone}.
Informazioni: {name}, {phone}, oppure {email}.
Inviare la domanda a {name}, {addr}.
Io sottoscritto {name}, residente in {addr}, dichiaro il vero.
Il sig. {last} ha richiamato; il suo cellulare è {phone}.
La dott.ssa {last} riceve in {addr}.
Cordiali saluti, {name}
Presenti {name}, {name} e la sig.ra {last}.
«Siamo contenti», dice {name}, titolare del negozio.
{name} abita in {addr} da trent'anni.
{name}, apicoltore, vende miele al mercato di {place}.
Il sindaco, {name}, ha tagliato il nastro.
Mittente: {name}, {addr}.
La sede si trova in {addr}, tel. {phone}.
Codice fiscale: {id:cf}
CF {id:cf} di {name}.
Passaporto n. {id:pass} rilasciato a {place}.
La ditta {firm} apre un deposito a {place}.
L'associazione {org} ha ricevuto {price}.
La fondazione {who} paga la cappella di {place}.
La scuola {who} e il liceo {who} hanno una sola mensa.
Ci vediamo in piazza {who}.
Il premio {who} va a un romanzo edito da {firm}.
Il treno delle {time} per {place} ha {num} minuti di ritardo.
A {place} il museo {place} mostra {num} tele.
Ordine n. {ref}, totale {price}.
ISBN {isbn}, {num} pagine.
Versione {ver}, indirizzo {ip}.
Dopo una lunga attesa il consiglio ha deciso.
""",
    "pt": """
Escrito por {name}, revisto por {name}.
{name} absteve-se.
Pessoa de contacto: {name}, {addr}, tel. {phone}
Para visitas ligue a {name}, {phone}.
Informações: {name}, {phone} ou {email}.
Envie a candidatura a {name}, {addr}.
Eu, {name}, residente em {addr}, declaro ser verdade.
O Sr. {last} ligou de volta; o telemóvel é {phone}.
A Dra. {last} atende em {addr}.
Com os melhores cumprimentos, {name}
Estiveram presentes {name}, {name} e a Sra. {last}.
«Estamos felizes», diz {name}, dona da loja.
{name} vive em {addr} há trinta anos.
{name}, apicultor, vende mel no mercado de {place}.
O presidente da câmara, {name}, cortou a fita.
Remetente: {name}, {addr}.
A sede fica em {addr}, tel. {phone}.
Número de contribuinte: {id:nine}
NIF {id:nine} de {name}.
Passaporte n.º {id:pass} emitido em {place}.
A empresa {firm} abre um armazém em {place}.
A associação {org} recebeu {price}.
A fundação {who} paga a capela de {place}.
A escola {who} e o liceu {who} partilham a cantina.
O prémio {who} vai para um romance da {firm}.
O comboio das {time} para {place} está atrasado {num} minutos.
Em {place}, o museu {place} mostra {num} telas.
Encomenda n.º {ref}, total {price}.
ISBN {isbn}, {num} páginas.
Depois de longa espera a assembleia decidiu.
""",
    "ru": """
По всем вопросам звоните: {name}, {phone}.
Пишите на {email} или звоните {phone}.
Заявление направьте по адресу: {addr}, {name}.
Я, {name}, проживающий по адресу {addr}, подтверждаю данные.
На собрании были {name}, {name} и {name}.
«Мы очень рады», — говорит {name}, хозяйка магазина.
{name} живёт по адресу {addr} тридцать лет.
Мэр {name} перерезал ленту.
С уважением, {name}
Паспорт {id:rupass}, выдан в городе {place}.
ИНН {id:tax}, {name}.
СНИЛС {id:snils}.
Отправитель: {name}, {addr}.
Фирма «{place}» открыла склад в городе {place}.
Музей «{place}» показывает {num} картин.
Река {place} впадает в озеро {place}.
Поезд в {time} до города {place} опаздывает на {num} минут.
Заказ № {ref}, сумма {num} рублей.
После долгого ожидания городской совет решил.
Улица {place} закрыта до {day} июня {year} года.
""",
    "ja": """
お問い合わせは{jname}さん（電話{phone}）まで。
連絡先：{jname}、{email}
{jname}氏は{year}年に会社を設立した。
{jname}様、いつもお世話になっております。
市議会は{num}円の予算を公開した。
博物館は{day}月{day}日に開館します。
雨のため試合は来週に延期されました。
「時間を教えてください」と彼は言って、出て行った。
""",
    "zh": """
联系人：{jname}，电话{phone}。
{jname}先生的邮箱是{email}。
{jname}女士于{year}年搬到这里。
市政府公布了{num}元的预算。
学校的老师和学生一起打扫了花园。
“谁能告诉我时间？”他问，然后走开了。
因为下雨，比赛推迟到下周，票价{num}元。
图书馆{day}月{day}日开放。
""",
    "*": """
☎ {phone}
✉ {email}
{email}
{email} / {phone}
{phone}
Tel. {phone}
E-mail: {email}
{name} {phone}
{name}, {phone}
{name} <{email}>
From: {name} <{email}>
To: {email}
{name}
{addr}
{name}
{addr}
{phone}
{addr}
{num}
{ref}
{place}
{day}.{day}.{year}
{place} ({day})
""",
}
# What firms and institutions are called by.
FIRM_FORMS = "SA SARL SAS GmbH AG KG Ltd Ltd. Inc. PLC S.p.A. S.r.l. S.L. Lda & Co et Cie & Söhne Frères Coop Group Industries".split(" ")
ORG_KINDS = {
    "fr": "Institut Cercle Club Comité Union Ligue Atelier Maison Réseau Théâtre Fédération Amicale Centre Groupe Conservatoire Forum Collège Fonds Observatoire".split(),
    "en": "Institute Circle Club Committee Union League Workshop House Network Theatre Federation Society Centre Group Trust Forum College Fund Observatory".split(),
    "de": "Institut Kreis Klub Verband Union Bund Werkstatt Haus Netzwerk Theater Gesellschaft Zentrum Gruppe Forum Kolleg Fonds Sternwarte".split(),
    "es": "Instituto Círculo Club Comité Unión Liga Taller Casa Red Teatro Federación Sociedad Centro Grupo Foro Colegio Fondo Observatorio".split(),
}
_LETTERS = "ABCDEFGHJKLMNPRSTVWXYZ"


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


class Filler:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs):
        return self.r.choice(xs)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def d(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def u(self, n: int) -> str:
        return "".join(self.pick(_LETTERS) for _ in range(n))

    def word(self, lang: str) -> str:
        """A word of syllables, with a capital."""
        k = self.pick((1, 1, 2, 2, 3))
        if lang == "ru":
            return ("".join(self.pick(_RU[0]) + self.pick(_RU[1]) for _ in range(k)) + self.pick(_RU[0]) + self.pick(_ENDS["ru"])).capitalize()
        return ("".join(self.pick(_ONSETS) + self.pick(_VOWELS) for _ in range(k)) + self.pick(_ENDS.get(lang, _ENDS["fr"]))).capitalize()

    def given(self, lang: str) -> str:
        known = FIRST.get(lang, FIRST["fr"]).split()
        one = lambda: self.pick(known) if self.chance(0.5) else self.word(lang)
        return f"{one()}-{one()}" if self.chance(0.08) else one()

    def last(self, lang: str) -> str:
        one = lambda: self.pick(LAST.get(lang, LAST["fr"]).split()) if self.chance(0.35) else self.word(lang)
        if self.chance(0.12):
            return f"{one()}-{one()}"
        if lang == "es" and self.chance(0.15):
            return f"{one()} {one()}"
        if self.chance(0.04):
            return self.pick({"de": ["von ", "zu "], "fr": ["de ", "Le ", "de la "], "it": ["De ", "Di "], "pt": ["da ", "dos "], "es": ["de la ", "del "]}.get(lang, ["van der ", "de "])) + one()
        return one()

    def name(self, lang: str) -> str:
        f, n = self.given(lang), self.last(lang)
        middle = f"{f} {self.u(1)}. {n}"
        return self.pick([f"{f} {n}"] * 9 + [f"{f[0]}. {n}", f"{f[0]}. {n}", f"{n.upper()} {f}", f"{f} {n.upper()}", middle, f"{f} {self.given(lang)} {n}"])

    def jname(self, lang: str) -> str:
        return self.pick("佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 王 李 张 刘 陈 杨 赵 黄".split()) + "".join(self.pick("明子太郎美健伟芳敏静丽强磊军洋勇艳杰花") for _ in range(self.pick((1, 2))))

    def who(self, lang: str) -> str:
        return f"{self.given(lang)} {self.last(lang)}" if self.chance(0.8) else self.last(lang)

    def place(self, lang: str) -> str:
        w = self.word(lang)
        return self.pick([w] * 8 + [f"{w}-{self.word(lang)}", {"fr": f"Saint-{w}", "es": f"San {w}", "en": f"St. {w}", "de": f"Bad {w}", "it": f"San {w}", "pt": f"São {w}"}.get(lang, w)])

    def org(self, lang: str) -> str:
        return f"{self.pick(ORG_KINDS.get(lang, ORG_KINDS['fr']))} {self.word(lang)}"

    def firm(self, lang: str) -> str:
        return self.pick([f"{self.word(lang)} {self.pick(FIRM_FORMS)}"] * 3 + [self.word(lang), f"{self.word(lang)} {self.word(lang)} {self.pick(FIRM_FORMS)}"])

    def phone(self, lang: str) -> str:
        d, s = self.d, self.pick(" .-/  ")
        fr = "0" + self.pick("1234567") + d(8)
        pairs = s.join(fr[i : i + 2] for i in range(0, 10, 2))
        nine = fr[1] + s + s.join(fr[i : i + 2] for i in range(2, 10, 2))
        forms = {
            "fr": [pairs, pairs, fr, f"+33 {nine}", f"+33{fr[1:]}", f"0033{fr[1:]}", f"+33 (0){nine}", f"0033 {nine}", f"(0){nine}", f"(+33) {nine}"],
            "en": [f"020 7{d(3)} {d(4)}", f"(020) 7{d(7)}", f"020 {d(8)}", f"+44 20 {d(4)} {d(4)}", f"0044 20 {d(4)} {d(4)}", f"+44 (0)20 {d(4)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(4)} {d(6)}", f"+44{d(10)}", f"07{d(3)} {d(3)} {d(3)}", f"1 ({d(3)}) {d(3)}-{d(4)}"],
            "de": [f"030/{d(8)}", f"+49 30 {d(8)}", f"(030) {d(5)}-{d(3)}", f"0{d(3)} {d(7)}", f"+49 (0)30 {d(8)}", f"0049 30 {d(8)}", f"030 {d(4)} {d(4)}", f"01{d(2)}-{d(7)}", f"+4930{d(8)}", f"030-{d(5)}-{d(3)}", f"0{d(2)}/{d(3)} {d(2)} {d(2)}", f"01{d(2)} {d(8)}"],
            "es": [s.join([self.pick("69") + d(2), d(3), d(3)]), f"{self.pick('69')}{d(2)} {d(3)} {d(3)}", f"(+34) {d(3)} {d(2)} {d(2)} {d(2)}", f"+34 {d(9)}", f"+34 {d(3)} {d(3)} {d(3)}", s.join([self.pick("69") + d(2), d(2), d(2), d(2)]), f"0034 {d(9)}", f"{self.pick('69')}{d(8)}"],
            "it": [f"0{d(1)} {d(8)}", f"+39 3{d(2)} {d(7)}", f"3{d(2)} {d(3)} {d(4)}", f"0{d(2)}/{d(7)}"],
            "pt": [f"9{d(2)} {d(3)} {d(3)}", f"+351 {d(3)} {d(3)} {d(3)}", f"2{d(8)}"],
            "ru": [f"+7 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"8 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"8 ({d(3)}) {d(3)} {d(2)} {d(2)}"],
            "ja": [f"03-{d(4)}-{d(4)}", f"090-{d(4)}-{d(4)}", f"0{d(2)}-{d(3)}-{d(4)}"],
            "zh": [f"1{d(10)}", f"010-{d(8)}", f"+86 1{d(2)} {d(4)} {d(4)}"],
        }
        return self.pick(forms[lang])

    def email(self, lang: str) -> str:
        src = lang if lang in FIRST and lang != "ru" else "en"
        f, n = (re.sub(r"[^a-z]", "", _plain(x)) or "info" for x in (self.given(src).split("-")[0], self.last(src).split("-")[0]))
        local = self.pick([f"{f}.{n}", f"{f[0]}{n}", f"{f}{self.d(2)}", f"{f}.{n}+news", f"{n}_{f}", "accueil", "office", f"{n}-{f}", f"{f[0]}.{n}", f"{f}{n}{self.d(4)}", f"{f}.{n}".upper()])
        host = self.pick(["", "", "mail.", "web.", "post-", "team-"]) + re.sub(r"[^a-z]", "", _plain(self.word("en")))
        parts = [*host.split("."), *self.pick(["example", "example.com", "example.org", "test", "invalid", "net", "fr", "de", "co.uk", "es"]).split(".")]
        at, dot = self.pick([("@", ".")] * 8 + [(" @ ", "."), (" (at) ", "."), (" [at] ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" arobase ", " point "), ("(at)", "."), ("[at]", "[dot]"), (" (arobase) ", " (point) "), (" {at} ", "."), (" arroba ", " punto "), ("(at)", "(punkt)"), ("＠", ".")])
        return local + at + dot.join(parts)

    def id(self, lang: str, kind: str) -> str:
        d, u, s = self.d, self.u, self.pick(["", " ", "-", ".", "/"])
        sex = self.pick("12")
        forms = {
            "nir": [s.join([sex, d(2), d(2), d(2), d(3), d(3), d(2)]), s.join([sex, d(2), d(2), d(2), d(3), d(3)]), f"{sex} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{sex}{d(12)} {d(2)}"] if lang == "fr" else [f"{d(2)} {d(6)} {u(1)} {d(3)}", f"{d(8)}{u(1)}{d(3)}"] if lang == "de" else [s.join([d(2), d(8), d(2)]), d(12)],
            "ssn": [s.join([d(3), d(2), d(4)]), f"{d(3)}-{d(2)}-{d(4)}", s.replace("/", " ").join([u(2), d(2), d(2), d(2), u(1)]), f"{u(2)}{d(6)}{u(1)}"],
            "card": [d(12), s.join([d(4), d(4), d(4)]), f"{u(1)}{d(8)}", f"{u(2)}{d(7)}", f"{u(1)}{d(2)}{u(1)}{d(5)}", f"{u(1)}{d(5)}{u(2)}{d(1)}", d(9)],
            "pass": [f"{u(1)}{d(8)}", f"{d(2)}{u(2)}{d(5)}", f"{d(2)} {u(2)} {d(5)}", d(9), f"{u(2)}{d(7)}", f"{u(3)}{d(6)}", f"{u(1)}{d(2)}{u(1)}{d(5)}"],
            "tax": [d(11), d(13), s.join([d(2), d(3), d(3), d(3)]), f"{d(2)} {d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}/{d(3)}/{d(5)}", d(10), d(12)],
            "dni": [f"{d(8)}{u(1)}", f"{d(8)}-{u(1)}", f"{d(8)} {u(1)}", f"{d(2)}.{d(3)}.{d(3)}-{u(1)}", f"{d(2)}.{d(3)}.{d(3)} {u(1)}", f"{self.pick('XYZ')}{d(7)}{u(1)}", f"{self.pick('XYZ')}-{d(7)}-{u(1)}"],
            "cf": [f"{u(6)}{d(2)}{u(1)}{d(2)}{u(1)}{d(3)}{u(1)}"],
            "nine": [d(9), f"{d(3)} {d(3)} {d(3)}"],
            "rupass": [f"{d(4)} {d(6)}", f"{d(2)} {d(2)} {d(6)}"],
            "snils": [f"{d(3)}-{d(3)}-{d(3)} {d(2)}"],
        }
        return self.pick(forms[kind])

    def _thing(self, lang: str) -> str:
        """What a street is called after."""
        return self.pick({
            "fr": ["des Lilas", "du Moulin", "de la Gare", "de l'Église", "Victor-Hugo", "aux Herbes", "du Général", "des Écoles", "de la République", "Neuve", "du Vieux Pont"],
            "en": ["Park", "Queen", "High", "Victoria", "Green", "Elm", "Bridge", "King", "North", "Rose", "Abbey"],
            "es": ["de Alcalá", "Mayor", "del Carmen", "de la Fuente", "Real", "de los Olivos", "del Sol", "Nueva"],
            "it": ["Toledo", "Garibaldi", "dei Mille", "della Libertà", "del Corso", "Roma", "delle Rose"],
            "pt": ["da Liberdade", "do Ouro", "das Flores", "Nova", "de São Bento", "do Carmo"],
        }.get(lang, ["Neuve"])) if self.chance(0.55) else self.pick([self.word(lang), f"{self.given(lang)} {self.last(lang)}", self.word(lang)])

    def street(self, lang: str) -> str:
        if lang == "de":
            return self.pick([f"{self.word('de')}{self.pick('straße weg gasse allee platz ring ufer damm'.split())}", f"{self.pick('Schul Garten Berg Kirch Bahnhof Haupt Rosen Wiesen'.split())}{self.pick('straße weg gasse allee platz'.split())}", self.pick(["Am Markt", "Am Bach", "An der Kirche", "Auf dem Berg", "Zum Anger", "Unter den Eichen"]), f"{self.word('de')}er Straße", f"{self.given('de')}-{self.last('de').split()[-1]}-Straße"])
        if lang == "en":
            return f"{self._thing('en').split()[-1]} {self.pick('Street Road Lane Avenue Drive Close Way Court Terrace Square Crescent Place Gardens Grove'.split())}"
        kinds = {"fr": "rue avenue boulevard place chemin allée impasse quai cours square passage route", "es": "calle avenida plaza paseo camino travesía ronda", "it": "via viale piazza corso largo vicolo", "pt": "rua avenida praça travessa largo"}[lang].split()
        return f"{self.pick(kinds)} {self._thing(lang)}"

    def addr(self, lang: str) -> str:
        d, place = self.d, self.place(lang if lang in FIRST else "en")
        n = str(self.r.randint(1, 2400 if lang == "en" and self.chance(0.4) else 260))
        if lang == "ru":
            return self.pick([f"ул. {self.word('ru')}, д. {n}, кв. {self.r.randint(1, 99)}", f"г. {place}, ул. {self.word('ru')}, д. {n}", f"ул. {self.word('ru')}, {n}, {place}"])
        if lang == "en":
            flat = self.pick(["", "", "", f"Flat {self.r.randint(1, 30)}, ", f"Apt {self.r.randint(1, 30)}, ", f"Unit {self.r.randint(1, 30)}, ", f"Suite {self.r.randint(1, 300)}, "])
            code = self.pick(["", f" {self.u(2)}{d(1)} {d(1)}{self.u(2)}", f", {self.u(2)}{d(2)} {d(1)}{self.u(2)}", f", {self.u(2)} {d(5)}", f" {d(5)}"])
            return f"{flat}{n}{self.pick(['', '', '', 'A', 'b'])} {self.street('en')}" + self.pick([f", {place}{code}", f", {place}{code}", "", f"\n{place}{code}"])
        pc = d(5) if lang != "pt" else f"{d(4)}-{d(3)}"
        if lang == "de":
            return f"{self.street('de')} {n}{self.pick(['', '', '', 'a', ' b'])}" + self.pick([f", {pc} {place}"] * 3 + [f"\n{pc} {place}", f", {place}", "", f" in {pc} {place}"])
        if lang in ("es", "pt", "it"):
            num = self.pick([f", {n}", f" {n}", f", n.º {n}", f", {n}"])
            floor = self.pick(["", "", "", f", {self.r.randint(1, 9)}.º {self.pick('ABCD')}", f", piso {self.r.randint(1, 9)}", f", {self.r.randint(1, 9)}º {self.pick(['izq.', 'dcha.', 'A', 'B'])[:3].rstrip('.')}"]) if lang != "it" else self.pick(["", "", f", interno {self.r.randint(1, 20)}"])
            return self.street(lang) + num + floor + self.pick([f", {pc} {place}"] * 3 + [f", {place}", ""])
        floor = self.pick(["", "", "", "", f", {self.r.randint(1, 9)}e étage", f", appt {self.r.randint(1, 60)}", f", bât. {self.pick('ABC')}"])
        town = self.pick([f", {pc} {place}"] * 3 + [f" {pc} {place}", f"\n{pc} {place}", f", {place}", "", f", {pc} {place} Cedex", f", {pc} {place} Cedex {self.r.randint(1, 20)}"])
        return f"{n}{self.pick(['', '', '', ' bis', ' ter', 'B', ' A'])}{self.pick([' ', ', ', ' '])}{self.street('fr')}{floor}{town}"

    def other(self, slot: str, lang: str) -> str:
        d, n = self.d, self.r.randint
        return {
            "day": lambda: str(n(1, 30)).zfill(self.pick([1, 2])),
            "year": lambda: str(n(1700, 2030)),
            "time": lambda: self.pick([f"{n(6, 22)}:{n(10, 59)}", f"{n(6, 22)} h {n(10, 59)}", f"{n(6, 22)}h{n(10, 59)}", f"{n(6, 22)}.{n(10, 59)}"]),
            "num": lambda: self.pick([d(1), d(2), d(3), d(4), d(5), d(6), f"{n(1, 99)} {d(3)}", f"{n(1, 99)}.{d(3)}", f"{n(1, 99)},{d(3)}", f"{n(1, 9)} {d(3)} {d(3)}", f"{n(1, 99)},{d(2)}"]),
            "price": lambda: self.pick([f"{n(1, 999)} €", f"{n(1, 99)},{d(2)} €", f"{n(1, 99)} {d(3)} euros", f"£{n(1, 999)}", f"{n(1, 99)}.{d(3)} Euro", f"${n(1, 99)},{d(3)}"]),
            "ref": lambda: self.pick([f"{d(5)}/{d(2)}", f"{self.u(1)}-{d(5)}", f"{self.u(2)}/{d(4)}/{d(2)}", f"{self.u(1)}/{d(5)}/{d(2)}", f"{d(4)}-{d(4)}", f"{self.u(3)}{d(4)}", d(6), d(7), f"{year}-{d(5)}" if (year := n(1990, 2030)) else ""]),
            "isbn": lambda: self.pick([f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"978{d(10)}", f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}"]),
            "geo": lambda: self.pick([f"{n(0, 89)}.{d(4)}", f"-{n(0, 179)}.{d(5)}", f"{n(0, 89)}.{d(3)}", f"{n(0, 89)}° {n(0, 59)}′"]),
            "ip": lambda: f"{n(1, 223)}.{n(0, 255)}.{n(0, 255)}.{n(1, 254)}",
            "ver": lambda: self.pick([f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", f"{n(0, 20)}.{n(0, 20)}", f"v{n(1, 9)}.{n(0, 99)}"]),
        }[slot]()


# Function words, page and article references, and nouns of buildings and bodies that take a name after them.
WORDS = {
    "fr": "le la les un une des du de à au aux en dans sur pour par avec sans sous et ou mais que qui dont où il elle on nous ils ne pas plus très bien encore déjà ce cette ses leur son sa a est ont sont été fait",
    "en": "the a an of to in on at for by with from and or but that which who where it he she they we not no very well still already this these its their his her has is have are was were been had",
    "de": "der die das ein eine des dem den von zu im am auf für durch mit ohne unter und oder aber dass wo er sie es wir nicht mehr sehr gut noch schon dieser diese sein ihr hat ist haben sind war wurde",
    "es": "el la los las un una de del a al en por para con sin sobre y o pero que quien donde él ella se no más muy bien aún ya este esta su sus ha es han son fue fueron",
    "it": "il lo la i gli le un una di del della a al alla in nel per con senza su e o ma che chi dove non più molto bene ancora già questo questa suo sua ha è hanno sono stato",
    "pt": "o a os as um uma de do da em no na por para com sem sobre e ou mas que quem onde não mais muito bem ainda já este esta seu sua tem é têm são foi foram",
    "ru": "и в на по с из у за к от до не что как это он она они мы но или же бы был была были для при об без под над уже ещё",
}
# Everyday nouns and first words of German, and nouns that follow a name in English.
NOUNS = "Stunde Stunden Tag Tage Tagen Woche Wochen Monat Monate Jahr Jahre Jahren Meter Metern Länge Breite Höhe Euro Zeit Haus Stadt Land Straße Wasser Arbeit Schule Kinder Frauen Männer Leute Menschen Besucher Gäste Bücher Bilder Karte Liste Plan Pläne Antrag Beratung Sitzung Bericht Brücke Kirche Garten Wald Berg Fluss Markt Preis Geld Gruppe Verein Rat Amt Fest Weg Ende Anfang Teil Seite Stimme Frage Antwort"
STARTERS = "Einige Viele Alle Mehrere Nach Seit Vor Während Zwischen Trotz Wegen Gegen Bei Heute Gestern Morgen Dort Dann Wenn Als Weil Obwohl Doch Aber Auch Nur Kurz Spät Früh"
PLACE_NOUNS = "Gate Bridge Hill Church Park Well Cross Green Mill Lodge Farm Hall House Quay Square Corner"
LEADS = {"fr": "le au du à", "en": "at from in of", "de": "der in aus an", "es": "en de la desde", "it": "in a da", "pt": "em na da", "ru": "на адрес"}
REFERENCES = "cf. p. 0|p. 00|art. 0|no. 00|vol. 0|S. 00|Nr. 0|Abs. 0|pág. 00|núm. 0|approx. 00|etc.|fig. 0|z. B.|z.B.|d. h.|u. a.|bzw.|p. ej.|p. ex.|e.g.|i.e.|№ 0|стр. 0|т. д.|§ 0|n° 00|00 %|00 km|00 m²|0,00 m|00 000"
NAMED = {
    "fr": "la Tour le Pont le Moulin la Fontaine le Kiosque le musée le programme le logiciel la barge le hameau la fonderie le glossaire le quai l'abbaye",
    "en": "the Tower the Mill the Bridge the Fountain the museum the program the barge the hamlet the foundry the glossary the abbey le Moulin la Tour",
    "de": "der Turm die Mühle die Brücke das Museum das Programm der Kahn der Weiler die Gießerei das Glossar die Abtei le Moulin la Tour",
    "es": "la Torre el Molino el Puente el museo el programa el barco la aldea la fundición el glosario la abadía le Moulin la Tour",
    "it": "la Torre il Mulino il Ponte il museo il programma la barca la fonderia il glossario l'abbazia le Moulin",
    "pt": "a Torre o Moinho a Ponte o museu o programa o barco a fundição o glossário a abadia le Moulin",
    "ru": "город деревня музей завод река озеро",
}


class Prose(Filler):
    """Sentences without sense: function words, made-up words, numbers, references, and names of places and bodies that are no persons."""

    def plain(self, lang: str) -> str:
        if lang == "de" and self.chance(0.5):
            return self.pick(NOUNS.split()) if self.chance(0.6) else self.word(lang)
        return self.word(lang).lower()

    def piece(self, lang: str) -> str:
        x = self.r.random()
        if x < 0.45:
            return self.pick(WORDS[lang].split())
        if x < 0.83:
            return self.plain(lang)
        if x < 0.88:
            return re.sub("0", lambda m: self.d(1), self.pick(REFERENCES.split("|")))
        if x < 0.90:
            return self.other(self.pick(("num", "year", "price", "ref", "ver", "time")), lang)
        if lang == "en" and x < 0.91:
            return f"{self.pick(('St. ', '', 'the '))}{self.word(lang)}'s {self.pick(PLACE_NOUNS.split())}"
        if lang == "de" and x < 0.91:
            return f"{self.r.randint(2, 99)} {self.pick(NOUNS.split())} {self.pick(NOUNS.split())}"
        if x < 0.925:
            return f"{self.pick(NAMED[lang].split())} {self.word(lang)}"
        if x < 0.94:
            return self.pick((self.firm, self.org, self.firm))(lang if lang in ORG_KINDS else "en" if lang != "ru" else "ru")
        return self.place(lang)

    def sentence(self, lang: str, inner: str = "") -> str:
        """A sentence; `inner` is put somewhere in it, at its start or its end too."""
        words = [self.pick(STARTERS.split()) if lang == "de" and self.chance(0.5) else self.pick(WORDS[lang].split()) if self.chance(0.6) else self.word(lang).lower(), *(self.piece(lang) for _ in range(self.r.randint(3, 13)))]
        if words[1][0].isupper() and lang != "de":
            words.insert(1, self.pick(WORDS[lang].split()))
        if inner:
            words.insert(self.pick((0, len(words), self.r.randint(0, len(words)))), inner)
        text = " ".join(w + ("," if self.chance(0.06) and w != inner and w[-1].isalnum() else "") for w in words)
        return (text if text.startswith("\0") else text[0].upper() + text[1:]) + self.pick((".", ".", ".", ".", "", "!", "?", "...", " :"))


_SLOT = re.compile(r"\{(\w+)(?::(\w+))?\}")
_DETAILS = {"name": "name", "last": "name", "jname": "name", "phone": "phone", "email": "email", "id": "identity", "addr": "address"}
#: Sentences of prose for each copy of the templates.
PROSE = 450
_FORMS = ("place", "org", "firm", "who", "street")


def labelled(seed: int = 7, copies: int = 5, part: int | None = None, held: bool = False, parts: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]) rows of the table.

    With `part` every `parts`-th template is held out: the rows are those of the
    other templates, or with `held` those of the held-out ones.
    """
    f = Filler(seed)
    out, k = [], 0
    for lang, block in TEMPLATES.items():
        lines = block.strip("\n").split("\n")
        if lang == "*":
            lines = [*lines, "{name}\n{addr}", "{name}\n{addr}\n{phone}", "{name}\n{phone}\n{email}"]
        for line in lines:
            k += 1
            if part is not None and (k % parts == part) != held:
                continue
            for _ in range(copies * (8 if lang == "*" else 3 if "{id:" in line else 1)):
                code = f.pick(("fr", "en", "de", "es", "it", "pt")) if lang == "*" else lang
                text, spans, at = "", [], 0
                for m in _SLOT.finditer(line):
                    text += line[at : m.start()]
                    slot, arg = m.groups()
                    value = f.id(code, arg) if slot == "id" else getattr(f, slot)(code) if slot in _DETAILS or slot in _FORMS else f.other(slot, code)
                    if slot in _DETAILS:
                        spans.append((_DETAILS[slot], len(text), len(text) + len(value)))
                    text += value
                    at = m.end()
                out.append((text + line[at:], spans))
    # details in prose of no sense, and prose without any
    g = Prose(seed + 1)
    for n in range(PROSE * copies):
        lang = g.pick(("fr", "en", "de", "es", "fr", "en", "de", "es", "it", "pt", "ru"))
        slot = g.pick(("name", "name", "name", "last", "addr", "addr", "phone", "email", "", "", "", ""))
        if not slot:
            text = " ".join(g.sentence(lang) for _ in range(g.pick((1, 1, 2))))
            out.append((text.upper() if g.chance(0.06) else text, []))
            continue
        value = getattr(g, slot)(lang)
        title = {"fr": "M. |Mme |Mlle ", "en": "Mr. |Mrs. |Ms ", "de": "Herr |Frau ", "es": "el Sr. |la Sra. |la Dra. ", "it": "il sig. |la dott.ssa ", "pt": "o Sr. |a Dra. ", "ru": "г-н "}[lang]
        lead = g.pick(title.split("|")) if slot == "last" else g.pick(LEADS[lang].split()) + " " if slot == "addr" and g.chance(0.5) else ""
        text = g.sentence(lang, f"\1{lead}\0")
        if text.startswith("\1"):
            lead = lead[:1].upper() + lead[1:]
            text = f"\1{lead}\0" + text[text.index("\0") + 1 :]
        text = text.replace("\1", "")
        at = text.index("\0")
        out.append((text[:at] + value + text[at + 1 :], [(_DETAILS[slot], at, at + len(value))]))
    # texts run on: rows stand in one paragraph, parted by a space or a line end
    rows = list(out)
    for _ in range(len(rows) // 4):
        (a, sa), (b, sb) = f.pick(rows), f.pick(rows)
        gap = f.pick([" ", " ", "\n"])
        out.append((a + gap + b, sa + [(k, s + len(a) + len(gap), e + len(a) + len(gap)) for k, s, e in sb]))
    return out
