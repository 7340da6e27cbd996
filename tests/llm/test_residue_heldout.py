"""Residue in other wordings than those of the test tables, written before the patterns
were widened and not used to write them; measured as a set, not case by case."""

from vulnlake.llm.residue import is_residue

RESIDUE = [
    # fields of mailers, office programs and web frameworks
    "Dear [First Name], your order has shipped.", "Hello %%first_name%%, thanks for joining.", "Dear *|FNAME|*, welcome back.", "Dear {FirstName LastName},\nwe regret to inform you.", 'Hello {{ user["name"] }}, your report is ready.',
    "Hi {{contact.firstname}},", "Kind regards,\n[Your Name]\n[Company Name]", "Dear {!Contact.FirstName},", "Your invoice ##INVOICE_NUMBER## is due.", "On {0} the vendor published {1}.", "Product: [Product Name]  Version: [Version Number]",
    "Dear {{#if name}}{{name}}{{/if}},", "Reply to [email address] within a week.", "Meeting on [Date] at [Time].", "Hello @@FirstName@@,", "<insert summary here>", "[TODO: describe the impact]", "The ticket {ticket_id} was closed by {agent_name}.", "Sincerely, {{ signature|safe }}", "Ship to: {{ order.address.city }}",
    # filler
    "Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy", "test test test test", "Coming soon!", "This page is under construction.", "Description to be added.", "Placeholder text", "blah blah blah blah blah", "TBD", "Enter text here", "Click to add text",
    # error pages
    "404\nPage not found\nThe page you are looking for does not exist.", "500 Internal Server Error\nnginx/1.18", "Oops! Something went wrong.", "Access Denied\nYou don't have permission to access this resource.", "This site can't be reached", "The requested issue page was not found.", "Error 404: the document could not be located",
    "503 Service Unavailable - No server is available to handle this request.", "Your session has timed out. Please log in again.", "Database connection failed: too many connections", "Checking your browser before accessing the site.", "Sidan kunde inte hittas", "Pagina non trovata", "ページが見つかりません", "Страница не найдена", "Error 1020: Access denied", "Sorry, you have been blocked", "We're sorry, an error occurred while processing your request.", "The server encountered an internal error or misconfiguration.",
    # notices about scripts
    "You need to enable JavaScript to run this app.", "JavaScript is disabled. Turn it on to continue.", "Please turn on JavaScript in your browser and reload the page.", "Du måste aktivera JavaScript för att använda den här sidan.", "Per favore abilita JavaScript nel tuo browser.", "Para usar este site, ative o JavaScript.", "Zet JavaScript aan om deze pagina te bekijken.", "Włącz JavaScript, aby kontynuować.",
    "Для работы сайта включите JavaScript.", "このサイトを利用するにはJavaScriptを有効にしてください。", "This application works best with JavaScript enabled.", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.", "Javascript must be enabled to use this form.", "Enable JavaScript and cookies to continue",
]
CONTENT = [
    "Use {{ name }} syntax in templates to insert a variable.", "The function returns {0, 1} for every input.", "The regular expression [A-Z]{2,4} matches two to four letters.", "See [1] and [Security Advisory 12] for details.", "[DSA 5123-1] openssl security update", "The array a[i] and the map m[key] are read before the check.",
    "int main(void) { return 0; }", "Set x = {1, 2, 3} and y = [4, 5].", "The patch replaces %s with %d in the log call.", "Use printf(\"%s\", name) instead of printf(name).", "A 404 response is sent when the file is missing.", "Attackers could cause a 500 Internal Server Error by sending a long header.", "The plugin shows an access denied message to anonymous users, which leaks the path.",
    "JavaScript is a programming language used on most web sites.", "An attacker can run JavaScript in the context of the victim.", "The flaw lets a script enable the debug interface.", "NoScript blocks the exploit.", "Disabling JavaScript mitigates the issue.", "Wer JavaScript abschaltet, ist nicht betroffen.", "Désactiver JavaScript réduit le risque.", "The vulnerability requires JavaScript to be enabled in the browser.",
    "We test every release on three platforms.", "Support for TLS 1.3 is coming soon to the stable branch.", "The page was under construction for two years before the release.", "A placeholder value is written to the table until the job ends.", "The lorem ipsum generator had a path traversal flaw.", "The sample text in the report is taken from the log.", "Our database connection pool leaks handles after a failed login.", "The session has a lifetime of one hour.",
    "Sessions that have timed out stay valid on the server.", "The request timed out after thirty seconds, so the client retried.", "Rate limits were exceeded by the scanner.", "Der Server meldet einen Fehler, wenn die Datei fehlt.", "Le serveur renvoie une erreur 500 quand le paramètre est vide.", "El servidor devuelve un error si falta el fichero.", "The <script> tag is not escaped in the title.", "Add <your key> only after reading the documentation, for example in the shell profile.",
    "The option {verbose} was removed; use --log instead, as in the syntax above.", "Yes no yes no yes no, said the log line of the voter.", "Versions 1.0, 1.1, 1.2, 1.3, 1.4 and 1.5 are affected.", "Error handling in the parser was rewritten.", "Not found in version 2.1, the defect first appears in 2.2.", "Fixed in 5.4.0 (unreleased).", "title = {The Design of Things}, year = {1999}",
]


def measure():
    hits = [t for t in RESIDUE if is_residue(t)]
    false = [t for t in CONTENT if is_residue(t)]
    return len(hits) / len(RESIDUE), len(hits) / max(1, len(hits) + len(false)), [t for t in RESIDUE if t not in hits], false


def test_recall_and_precision_on_other_wordings():
    recall, precision, missed, false = measure()
    assert recall >= 0.9 and precision >= 0.95, (recall, precision, missed, false)
