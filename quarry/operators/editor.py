"""An editor's requests answered by the operators: open documents over files, lookups by point, edits as text changes.

``Editor.request`` takes a protocol method and its parameters as dictionaries
and gives plain lists and dictionaries of one document's size.  Open documents
stand before the files; what a request needs is parsed once per state of the
documents.  Handlers are registered by method, so others of higher priority
may take their place.  Lines count from 0 here, as editors count them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import commands, diagnostics, edits, liveness, refactor, views
from quarry.operators.rules import Modules
from quarry.sources import project

#: Request methods and the capability each one announces.
CAPABILITIES = {
    "textDocument/definition": "definitionProvider", "textDocument/references": "referencesProvider", "textDocument/hover": "hoverProvider", "textDocument/documentSymbol": "documentSymbolProvider", "textDocument/completion": "completionProvider",
    "textDocument/rename": "renameProvider", "textDocument/prepareRename": "renameProvider", "textDocument/documentHighlight": "documentHighlightProvider", "textDocument/foldingRange": "foldingRangeProvider", "textDocument/formatting": "documentFormattingProvider",
    "textDocument/codeAction": "codeActionProvider", "textDocument/signatureHelp": "signatureHelpProvider", "textDocument/inlayHint": "inlayHintProvider", "textDocument/codeLens": "codeLensProvider", "textDocument/semanticTokens/full": "semanticTokensProvider",
    "textDocument/prepareCallHierarchy": "callHierarchyProvider", "callHierarchy/incomingCalls": "callHierarchyProvider", "callHierarchy/outgoingCalls": "callHierarchyProvider", "textDocument/typeDefinition": "typeDefinitionProvider", "textDocument/implementation": "implementationProvider",
    "workspace/symbol": "workspaceSymbolProvider", "workspace/executeCommand": "executeCommandProvider",
}


class Editor:
    """A session: settings, open documents, and the analyses of their present state."""

    def __init__(self, spark: SparkSession, files: DataFrame, scenes: DataFrame | None = None):
        self.spark, self.files, self.scenes = spark, files, scenes
        self.documents: dict[str, tuple[int, str]] = {}
        self.state, self.trace, self.settings = "new", "off", {}
        self._analysed: commands.Analysed | None = None
        self.handlers = Modules()
        for name in dir(self):
            if name.startswith("on_"):
                self.handlers.register(METHODS[name], getattr(self, name))

    # --- documents and life -----------------------------------------------------------------

    def request(self, method: str, params: dict | None = None):
        """The answer to a request or notification; after ``shutdown`` only ``exit`` is taken."""
        if self.state == "shutdown" and method != "exit":
            raise RuntimeError("the session is shut down")
        return self.handlers.call(method, params or {})

    def on_initialize(self, params: dict):
        self.state = "ready"
        return {"capabilities": dict.fromkeys(sorted(set(CAPABILITIES.values())), True) | {"textDocumentSync": 2}}

    def on_initialized(self, params: dict):
        return None

    def on_shutdown(self, params: dict):
        self.state = "shutdown"

    def on_exit(self, params: dict):
        self.documents.clear()
        return 0 if self.state == "shutdown" else 1

    def on_set_trace(self, params: dict):
        self.trace = params.get("value", "off")

    def on_configuration(self, params: dict):
        self.settings |= params.get("settings", {})

    def on_open(self, params: dict):
        doc = params["textDocument"]
        self._put(doc["uri"], doc.get("version", 0), doc["text"])
        return self.diagnostics(doc["uri"])

    def on_change(self, params: dict):
        """Changes in order; one of an older version than the open document's is left out."""
        uri, version = params["textDocument"]["uri"], params["textDocument"].get("version", 0)
        have, text = self.documents.get(uri, (-1, ""))
        if version < have:
            return None
        for change in params["contentChanges"]:
            if "range" in change:
                a, b = change["range"]["start"], change["range"]["end"]
                text = refactor.apply_edits(text, [refactor.Edit(a["line"] + 1, a["character"], b["line"] + 1, b["character"], change["text"])])
            else:
                text = change["text"]
        self._put(uri, version, text)
        return self.diagnostics(uri)

    def on_close(self, params: dict):
        self.documents.pop(params["textDocument"]["uri"], None)
        self._analysed = None

    def on_save(self, params: dict):
        return self.diagnostics(params["textDocument"]["uri"])

    def _put(self, uri: str, version: int, text: str) -> None:
        self.documents[uri] = (version, text)
        self._analysed = None

    @property
    def now(self) -> commands.Analysed:
        if self._analysed is None:
            files = self.files.select("path", "text")
            if self.documents:
                opened = self.spark.createDataFrame([(p, t) for p, (_, t) in sorted(self.documents.items())], "path string, text string")
                files = files.join(opened.select("path"), "path", "left_anti").unionByName(opened)
            self._analysed = commands.Analysed(files, self.scenes)
        return self._analysed

    def text_of(self, uri: str) -> str:
        if uri in self.documents:
            return self.documents[uri][1]
        row = self.files.where(F.col("path") == uri).select("text").first()
        return row.text if row else ""

    def _point(self, params: dict) -> DataFrame:
        at = params["position"]
        return self.spark.createDataFrame([(params["textDocument"]["uri"], at["line"] + 1, at["character"])], "path string, line int, col int")

    def _word(self, params: dict) -> str | None:
        """The name at a point."""
        lines = self.text_of(params["textDocument"]["uri"]).split("\n")
        at = params["position"]
        line = lines[at["line"]] if at["line"] < len(lines) else ""
        start = end = at["character"]
        while start > 0 and (line[start - 1].isalnum() or line[start - 1] == "_"):
            start -= 1
        while end < len(line) and (line[end].isalnum() or line[end] == "_"):
            end += 1
        return line[start:end] or None

    def _start(self, params: dict) -> DataFrame:
        """The point at which the name at a point begins."""
        lines = self.text_of(params["textDocument"]["uri"]).split("\n")
        at = dict(params["position"])
        line = lines[at["line"]] if at["line"] < len(lines) else ""
        while at["character"] > 0 and (line[at["character"] - 1].isalnum() or line[at["character"] - 1] == "_"):
            at["character"] -= 1
        return self._point(params | {"position": at})

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: [str(r[k]) if not isinstance(r[k], int) else f"{r[k]:09d}" for k in r])

    def _mine(self, df: DataFrame, params: dict) -> list[dict]:
        return self._rows(df.where(F.col("path") == params["textDocument"]["uri"]).drop("path"))

    def diagnostics(self, uri: str) -> list[dict]:
        return self._mine(commands.analyze(self.now, "warning"), {"textDocument": {"uri": uri}})

    # --- lookups -------------------------------------------------------------------------------

    def on_definition(self, params: dict):
        return self._rows(views.definitions(self.now.model, self._start(params)).select("at", (F.col("at_line") - 1).alias("line")))

    def on_type_definition(self, params: dict):
        return self._rows(views.type_definitions(self.now.model, self._start(params)).select("type", "at"))

    def on_references(self, params: dict):
        word = self._word(params)
        return self._rows(views.references(self.now.model, word)) if word else []

    def on_implementation(self, params: dict):
        found = views.implementations(self.now.model)
        return self._rows(found.where((F.col("name") == (self._word(params) or "")) & (F.col("base_path") == params["textDocument"]["uri"])))

    def on_hover(self, params: dict):
        docs = views.doc_comments(self.now.files, self.now.rows())
        return next(iter(self._rows(views.hover(self.now.model, self._start(params), docs).select("name", "type", "doc"))), None)

    def on_document_symbol(self, params: dict):
        return self._mine(views.document_symbols(self.now.rows()), params)

    def on_workspace_symbol(self, params: dict):
        return self._rows(views.workspace_symbols(self.now.facts, params.get("query", "")))

    def on_completion(self, params: dict):
        """Members of the type before the dot, or the names of the script."""
        at, uri = params["position"], params["textDocument"]["uri"]
        before = self.text_of(uri).split("\n")[at["line"]][: at["character"]].rstrip()
        if before.endswith("."):
            used = self._rows(diagnostics.of_kind(self.now.facts, "use", "member").where((F.col("path") == uri) & (F.col("name") == before[:-1].split()[-1].split("(")[-1])).select("type").distinct())
            kinds = [r["type"] for r in used if r["type"]]
            return self._rows(views.completions(self.now.model, self.spark, kinds[0].split("[")[0])) if kinds else []
        return self._mine(self.now.model.members.select("path", "name", F.col("member").alias("kind")), params)

    def on_signature_help(self, params: dict):
        uri, at = params["textDocument"]["uri"], params["position"]
        before = self.text_of(uri).split("\n")[at["line"]][: at["character"]]
        name = before[: before.rfind("(")].split()[-1].split(".")[-1] if "(" in before else None
        found = self._mine(views.signatures(self.now.model).where(F.col("name") == (name or "")), params)
        return found[0] | {"activeParameter": before[before.rfind("(") :].count(",")} if found else None

    def on_highlight(self, params: dict):
        return self._rows(views.highlights(self.now.facts, self._start(params)).drop("path"))

    def on_folding(self, params: dict):
        return self._mine(views.folding_ranges(self.now.rows()), params)

    def on_semantic_tokens(self, params: dict):
        return self._mine(views.semantic_tokens(self.now.facts), params)

    def on_inlay_hint(self, params: dict):
        return self._mine(views.inlay_hints(self.now.facts), params)

    def on_code_lens(self, params: dict):
        return self._mine(views.reference_counts(self.now.model), params)

    def on_prepare_calls(self, params: dict):
        word = self._word(params)
        return self._mine(self.now.model.members.where((F.col("member") == "func") & (F.col("name") == (word or ""))).select("path", "name", "at"), params)

    def on_incoming(self, params: dict):
        item = params["item"]
        return self._rows(views.incoming_calls(self.now.model).where((F.col("target_path") == item["at"]) & (F.col("target") == item["name"])))

    def on_outgoing(self, params: dict):
        item = params["item"]
        return self._rows(views.inference_dependencies(self.now.model).where((F.col("path") == item["at"]) & (F.col("method") == item["name"])))

    # --- edits -----------------------------------------------------------------------------------

    def on_prepare_rename(self, params: dict):
        word = self._word(params)
        return {"placeholder": word} if word and self._rows(views.references(self.now.model, word).limit(1)) else None

    def on_rename(self, params: dict):
        """Edits of every place that surely names the member, by file."""
        word, new = self._word(params), params["newName"]
        places = project.parsed(self.now.files)
        plan = edits.rename_plan(project.nodes(places), project.uses(places), word or "", new).where("confidence = 'Strict'")
        out: dict[str, list[dict]] = {}
        for r in self._rows(plan.select("path", "line", "col")):
            out.setdefault(r["path"], []).append({"line": r["line"] - 1, "character": r["col"], "length": len(word or ""), "newText": new})
        return out

    def on_formatting(self, params: dict):
        row = self.now.files.where(F.col("path") == params["textDocument"]["uri"]).select(edits.formatted(F.col("text")).alias("t")).first()
        return row.t if row else None

    def on_code_action(self, params: dict):
        """Refactorings that would change something at a line."""
        text, line = self.text_of(params["textDocument"]["uri"]), params["range"]["start"]["line"] + 1
        tries = {"invert_condition": (line,), "convert_for_to_while": (line,), "add_type_annotations": (), "remove_comments": (), "reorder_members": ()}
        return sorted(name for name, given in tries.items() if refactor.PLANNERS[name](text, *given))

    def on_execute(self, params: dict):
        """A planner applied to a document, or a report by name."""
        name, given = params["command"], params.get("arguments", [])
        if name in refactor.PLANNERS:
            uri, *rest = given
            text = refactor.apply_edits(self.text_of(uri), refactor.PLANNERS[name](self.text_of(uri), *rest))
            self._put(uri, self.documents.get(uri, (0, ""))[0] + 1, text)
            return text
        return self._rows(COMMANDS[name](self.now, *given))


METHODS = {
    "on_initialize": "initialize", "on_initialized": "initialized", "on_shutdown": "shutdown", "on_exit": "exit", "on_set_trace": "$/setTrace", "on_configuration": "workspace/didChangeConfiguration", "on_open": "textDocument/didOpen", "on_change": "textDocument/didChange",
    "on_close": "textDocument/didClose", "on_save": "textDocument/didSave", "on_definition": "textDocument/definition", "on_type_definition": "textDocument/typeDefinition", "on_references": "textDocument/references", "on_implementation": "textDocument/implementation",
    "on_hover": "textDocument/hover", "on_document_symbol": "textDocument/documentSymbol", "on_workspace_symbol": "workspace/symbol", "on_completion": "textDocument/completion", "on_signature_help": "textDocument/signatureHelp", "on_highlight": "textDocument/documentHighlight",
    "on_folding": "textDocument/foldingRange", "on_semantic_tokens": "textDocument/semanticTokens/full", "on_inlay_hint": "textDocument/inlayHint", "on_code_lens": "textDocument/codeLens", "on_prepare_calls": "textDocument/prepareCallHierarchy", "on_incoming": "callHierarchy/incomingCalls",
    "on_outgoing": "callHierarchy/outgoingCalls", "on_prepare_rename": "textDocument/prepareRename", "on_rename": "textDocument/rename", "on_formatting": "textDocument/formatting", "on_code_action": "textDocument/codeAction", "on_execute": "workspace/executeCommand",
}


def _parsed(a: commands.Analysed) -> tuple[DataFrame, DataFrame]:
    found = project.parsed(a.files)
    return project.nodes(found), project.uses(found)


#: Reports by the name they have on a command line, over a ``commands.Analysed``.
COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "analyze": commands.analyze, "check": commands.check, "validate": commands.validate, "list": commands.list_all, "find-refs": commands.find_refs,
    "dead-code": lambda a: liveness.report(liveness.Evidence(a.model)), "deps": lambda a: views.type_dependencies(a.model), "extract-style": lambda a: commands.extract_style(a.files), "parse": lambda a: commands.print_tree(a.files),
    "symbols": lambda a: views.document_symbols(a.rows()), "lint": lambda a: a.issues, "stats": lambda a: commands.stats(a.files, *_parsed(a)), "metrics": lambda a: commands.code.method_metrics(*_parsed(a)),
    "type-coverage": lambda a: commands.code.type_coverage(_parsed(a)[0]), "format": lambda a: a.files.select("path", edits.formatted(F.col("text")).alias("text")), "rename": lambda a, old, new: edits.rename_plan(*_parsed(a), old, new),
    "list classes": lambda a: views.list_classes(a.facts), "list signals": lambda a: views.list_signals(a.facts), "list methods": lambda a: views.list_members(a.facts, "func"), "list variables": lambda a: views.list_members(a.facts, "var"), "list enums": lambda a: views.list_members(a.facts, "enum"),
    "list exports": lambda a: diagnostics.of_kind(a.facts, "variable").where("contains(detail, 'export')").select("path", "name", "type"), "list engine-callbacks": lambda a: views.list_engine_callbacks(a.facts),
    "list scenes": lambda a: views.list_scenes(project.scene_nodes(a.scenes)), "list nodes": lambda a: project.scene_nodes(a.scenes), "list resources": lambda a: views.list_resources(project.scene_resources(a.scenes), a.files),
}
