"""Curated subject terms in English, German, Spanish and French.

Fixed values: per subject the terms of the field, separated by commas; plural forms need no entry. A term that stands
under several subjects counts less for each (see `weights`).
"""

from __future__ import annotations

TERMS = {
    "databases": """view, checkpoint, index, migration, shard, page cache, deadlock, trigger, foreign key, replica, snapshot, join order, query plan, schema change, row lock, isolation level, cursor, vacuum run, connection pool, stored procedure, table scan, partition key, write-ahead log, transaction log,
        tabelle, spalte, fremdschlüssel, abfrageplan, sperre, transaktion, replikat,
        tabla, columna, clave foránea, plan de consulta, bloqueo, transacción, réplica, índice,
        table, colonne, clé étrangère, plan de requête, verrou, transaction, réplique""",
    "web_frontend": """view, bundle, component, router, tooltip, animation frame, click target, theme token, grid layout, media query, browser tab, stylesheet, event handler, form field, render loop, state hook, dropdown, accessibility label, modal dialog, shadow tree, hydration step, viewport, scroll container, font loader,
        menü, ansicht, schaltfläche, formularfeld, stilvorlage, browserfenster, komponente, schriftart,
        botón, menú, vista, fuente, componente, campo de formulario, hoja de estilos, ventana del navegador,
        vue, menu, composant, bouton, police, feuille de style, champ de formulaire, fenêtre du navigateur""",
    "networking": """router, firewall rule, socket, keepalive, tunnel, congestion window, name lookup, handshake, retry budget, port range, proxy hop, multicast group, switch, gateway, link, peer list, mesh sidecar, load balancer, latency probe, route table, subnet, bandwidth cap, packet capture, stream frame, round trip,
        netzmaske, leitung, lastverteiler, paket, bandbreite, verbindung, namensauflösung,
        balanceador, paquete, subred, enrutador, enlace, ancho de banda, resolución de nombres, conexión,
        répartiteur, lien, connexion, routeur, sous-réseau, paquet, bande passante, résolution de noms""",
    "machine_learning": """checkpoint, kernel, batch, calibration plot, warm-up phase, confusion matrix, learning rate, dropout mask, recall score, cluster label, optimiser state, loss curve, token vocabulary, training batch, attention head, baseline model, fine-tuning run, validation split, reward model, gradient norm, label noise, inference server, hyperparameter sweep, embedding layer, feature store,
        merkmal, modell, trainingslauf, lernrate, gewichtung, vorhersage, verlustkurve, stichprobe,
        modelo, ponderación, entrenamiento, tasa de aprendizaje, atributo, predicción, muestra, curva de pérdida,
        attribut, échantillon, prédiction, modèle, entraînement, pondération, courbe de perte, taux d'apprentissage""",
    "build_tooling": """bundle, kernel, link, linker flag, pipeline stage, release tag, test shard, monorepo, compiler warning, container image, nightly job, dependency graph, build matrix, target, include path, version bump, incremental build, signing step, generated stub, package registry, artifact, runner, build cache, workspace file, lockfile,
        laufumgebung, artefakt, übersetzer, bauprozess, abhängigkeit, paketquelle, zwischenspeicher, veröffentlichung,
        enlazador, caché, artefacto, compilación, dependencia, publicación, registro de paquetes, entorno de ejecución,
        compilation, publication, cache, artefact, dépendance, éditeur de liens, environnement d'exécution, registre de paquets""",
    "security": """firewall rule, audit trail, nonce, policy file, second factor, rate limit, phishing drill, signature check, encryption key, permission check, access token, attack surface, certificate chain, password hash, secret rotation, sandbox escape, threat model, privilege boundary, vulnerability report, session cookie, revocation list, login flow, role binding, input sanitiser,
        schlüssel, zugriffsrecht, schwachstelle, angriff, kennwort, anmeldung, zertifikat, prüfprotokoll,
        vulnerabilidad, contraseña, auditoría, ataque, certificado, permiso de acceso, inicio de sesión, clave de cifrado,
        authentification, vulnérabilité, attaque, certificat, droit d'accès, clé de chiffrement, mot de passe, piste d'audit""",
    "law": """bill, settlement, appeal, statute, contract draft, court ruling, evidence list, witness statement, clause, injunction, hearing date, licence term, defendant, arbitration, jurisdiction, party, affidavit, indemnity, precedent, trademark filing, liability cap, plaintiff, notary, legal brief, court,
        berufung, vertragsentwurf, zeugenaussage, klägerin, urteil, haftung, klausel, gesetz,
        ley, testigo, demandante, responsabilidad, apelación, borrador de contrato, cláusula, sentencia,
        appel, témoin, plaignante, loi, responsabilité, jugement, projet de contrat""",
    "sport": """half-time score, coach, goalkeeper, medal count, penalty shoot-out, home match, court, marathon pace, injury list, training ground, substitute, referee, free kick, club badge, tournament bracket, season opener, league table, transfer window, sprint final, tackle, relay team, away fixture, league fixture, stadium,
        schiedsrichter, heimspiel, stadion, tabellenplatz, torhüterin, elfmeter, turnier, trainingslager,
        estadio, portera, pretemporada, torneo, árbitro, penalti, partido en casa, clasificación,
        arbitre, tournoi, penalty, stade, gardienne, match à domicile, stage de préparation, classement""",
    "astronomy": """calibration plot, field of view, spectral line, orbit, comet tail, moon, exposure, parallax, nebula, observation night, eclipse, planet candidate, dust ring, magnitude, light curve, telescope, pulsar, redshift, sky survey, mirror segment, star cluster, red giant, galaxy arm, transit depth,
        galaxie, umlaufbahn, komet, sternhaufen, teleskop, spektrallinie, finsternis, lichtkurve,
        cometa, curva de luz, galaxia, línea espectral, órbita, telescopio, cúmulo estelar,
        éclipse, télescope, comète, courbe de lumière, raie spectrale, orbite, amas d'étoiles""",
    "finance": """bill, settlement, audit trail, accrual, loan, hedge, bond yield, invoice, portfolio, interest rate, pension plan, dividend, quarterly report, budget line, margin call, share price, balance sheet, cash flow, credit line, ledger entry, tax form, risk limit, payment term, exchange rate,
        haushaltsposten, wechselkurs, rechnung, anleihe, zinssatz, bilanz, buchung, dividende,
        balance, bono, factura, tipo de cambio, tipo de interés, partida presupuestaria, dividendo, asiento contable,
        bilan, obligation, facture, taux de change, taux d'intérêt, ligne budgétaire, écriture comptable""",
    "medicine": """prescription, blood sample, heart rhythm, dosage, patient chart, side effect, trial arm, symptom diary, diagnosis, biopsy, ward round, placebo, relapse, cell count, allergy note, bone density, nurse station, scan report, surgery slot, antibody level, vaccine lot, intake form, triage desk, fever curve,
        nebenwirkung, visite, befund, impfstoff, blutprobe, diagnose, dosierung, patientenakte,
        diagnóstico, hallazgo, vacuna, ronda médica, dosis, efecto secundario, muestra, muestra de sangre, historia clínica,
        diagnostic, prise de sang, vaccin, effet secondaire, dossier médical, posologie, résultat d'examen, compte rendu, tournée des patients""",
    "cooking": """marinade, dough, glaze, roast, caramel, stew, batch, broth, yeast starter, pantry shelf, seasoning, recipe card, garnish, dressing, baking tray, pastry crust, tasting note, whisk, simmering pot, dumpling, spice mix, oven temperature, chopping board,
        portion, soße, rezept, teig, backblech, brühe, ofentemperatur, gewürz,
        ración, salsa, receta, masa, bandeja de horno, bandeja, caldo, temperatura del horno, especia,
        sauce, recette, pâte, plaque de four, plaque de cuisson, bouillon, température du four, épice""",
}


#: Further terms of each field, from general knowledge of it.
GENERAL = {
    "databases": "b-tree, inverted index, query optimiser, query optimizer, two-phase commit, primary key, unique constraint, materialised view, materialized view, relational algebra, normal form, snapshot isolation, log sequence number, hash join, merge join, sql statement, tablespace, rowstore, column store",
    "web_frontend": "web component, css selector, flexbox, service worker, virtual dom, single-page application, responsive layout, web font, progress spinner, navigation bar, hover state, aria attribute, client-side routing, breadcrumb trail, carousel, favicon, keyframe animation",
    "networking": "ip address, mac address, tcp connection, udp datagram, border gateway protocol, network interface, default gateway, packet loss, network topology, vlan, ethernet frame, dns resolver, reverse proxy, network switch, traffic shaping, quality of service, autonomous system",
    "machine_learning": "neural network, gradient descent, backpropagation, random forest, support vector machine, overfitting, regularisation, regularization, transformer model, language model, feature vector, training set, test set, cross-entropy, decision tree, k-means, reinforcement learning, batch normalisation, batch normalization",
    "build_tooling": "continuous integration, makefile, build script, build system, package manager, semantic versioning, static linking, dynamic linking, cross-compilation, object file, source map, dependency resolution, docker image, release branch, build server, toolchain, code generator",
    "security": "cross-site scripting, sql injection, buffer overflow, penetration test, zero-day, public key, private key, digital signature, brute-force attack, man-in-the-middle attack, malware, ransomware, intrusion detection, least privilege, two-factor authentication, access control list, security patch",
    "law": "supreme court, court of appeal, civil law, criminal law, common law, prosecutor, defence counsel, defense counsel, litigation, subpoena, tort, breach of contract, power of attorney, intellectual property, copyright infringement, due process, constitutional right, custody hearing, legal counsel, statute of limitations",
    "sport": "world cup, olympic games, world record, football club, basketball court, tennis match, championship game, head coach, offside, quarterfinal, semifinal, swimming pool, track and field, personal best, goal difference, extra time, hat-trick, batting average, grand slam, marathon runner",
    "astronomy": "black hole, supernova, white dwarf, neutron star, exoplanet, solar system, milky way, dark matter, asteroid belt, radio telescope, event horizon, light year, celestial sphere, constellation, cosmic microwave background, lunar crater, solar flare, hubble constant, right ascension, declination",
    "finance": "stock market, mutual fund, hedge fund, income statement, capital gain, central bank, mortgage rate, credit rating, derivative contract, call option, put option, return on equity, price-earnings ratio, venture capital, treasury bill, equity stake, working capital, foreign exchange, accounts payable, accounts receivable",
    "medicine": "clinical trial, blood pressure, chronic disease, antibiotic, chemotherapy, intensive care, physical therapy, surgeon, radiology, cardiology, immune system, insulin dose, medical history, heart attack, stroke patient, vaccine dose, mri scan, ct scan, general anaesthesia, general anesthesia, outpatient clinic",
    "cooking": "olive oil, baking powder, baking soda, frying pan, cutting board, tomato sauce, whipped cream, sourdough, bread flour, puff pastry, pinch of salt, medium heat, slow cooker, rolling pin, minced garlic, chicken stock, food processor, egg white, egg yolk, preheated oven",
}


#: Words that are no evidence alone, but tell which subject a term of several subjects stands for.
CLUES = {
    "databases": "reindex, commit, backfill, replicate, normalise, roll back, vacuum",
    "web_frontend": "restyle, mount, animate, render, hydrate, memoise, debounce, lazy load",
    "networking": "multiplex, throttle, drop, ping, forward, reroute, resolve",
    "machine_learning": "embed, quantise, train, overfit, calibrate, distil, regularise, converge",
    "build_tooling": "cache, compile, publish, pin, rebuild, vendor, tag",
    "security": "revoke, sanitise, rotate, encrypt, harden, exploit, sign, audit",
    "law": "testify, overturn, sue, indemnify, litigate, enforce, ratify",
    "sport": "train, dribble, win, score, serve, sprint, qualify",
    "astronomy": "expose, transit, track, observe, calibrate, collapse",
    "finance": "accrue, refund, amortise, write off, invest, reconcile",
    "medicine": "diagnose, operate, treat, vaccinate, dose, prescribe, screen",
    "cooking": "simmer, fry, knead, proof, season",
}


def weights(terms: dict[str, str] | None = None, clues: dict[str, str] | None = None) -> dict[str, dict[str, float]]:
    """Per term (single spaces, no hyphens or apostrophes) its subjects with weight 1 / number of subjects; clues that
    are no terms have weight 0."""
    if terms is None:
        terms = {s: f"{listed}, {GENERAL[s]}" for s, listed in TERMS.items()}
        clues = CLUES if clues is None else clues
    by_term: dict[str, set[str]] = {}
    by_clue: dict[str, set[str]] = {}
    for into, source in ((by_term, terms), (by_clue, clues or {})):
        for subject, listed in source.items():
            for t in listed.split(","):
                t = " ".join(t.replace("-", " ").replace("'", " ").split()).lower()
                if t:
                    into.setdefault(t, set()).add(subject)
    return {t: dict.fromkeys(sorted(s), 0.0) for t, s in by_clue.items()} | {t: dict.fromkeys(sorted(s), 1 / len(s)) for t, s in by_term.items()}
