"""Names whose content and order decide results, as tuples in the order in which they are tried."""

from __future__ import annotations

# Untrusted input by language, with its kind.
SOURCES = {
    "java": (
        ("getParameter", "http_param"),
        ("getParameterValues", "http_param"),
        ("getQueryString", "http_param"),
        ("getHeader", "http_header"),
        ("getHeaders", "http_header"),
        ("getCookies", "http_param"),
        ("getReader", "http_body"),
        ("getInputStream", "http_body"),
        ("getParts", "http_body"),
        ("getParameterMap", "http_param"),
        ("getAttribute", "http_param"),
        ("getPathVariable", "http_param"),
        ("getRequestBody", "http_body"),
        ("readLine", "stdin"),
        ("nextLine", "stdin"),
        ("getPathInfo", "http_param"),
        ("getServletPath", "http_param"),
        ("Part.getInputStream", "http_body"),
        ("Part.getSubmittedFileName", "http_param"),
        ("System.getenv", "env_var"),
        ("System.getProperty", "env_var"),
        ("System.getProperties", "env_var"),
    ),
    "python": (
        ("request.args", "http_param"),
        ("request.form", "http_body"),
        ("request.json", "http_body"),
        ("request.data", "http_body"),
        ("request.headers", "http_header"),
        ("request.cookies", "http_param"),
        ("request.files", "http_body"),
        ("request.query_string", "http_param"),
        ("request.values", "http_param"),
        ("request.get_json", "http_body"),
        ("request.get_data", "http_body"),
        ("request.form.get", "http_body"),
        ("request.args.get", "http_param"),
        ("request.headers.get", "http_header"),
        ("Query", "http_param"),
        ("Body", "http_body"),
        ("Header", "http_header"),
        ("Cookie", "http_param"),
        ("Path", "http_param"),
        ("File", "http_body"),
        ("request.GET", "http_param"),
        ("request.POST", "http_body"),
        ("request.body", "http_body"),
        ("request.META", "http_header"),
        ("request.FILES", "http_body"),
        ("os.environ", "env_var"),
        ("os.getenv", "env_var"),
        ("environ.get", "env_var"),
        ("sys.stdin", "stdin"),
        ("sys.argv", "http_param"),
        ("input", "stdin"),
    ),
    "js": (
        ("req.query", "http_param"),
        ("req.body", "http_body"),
        ("req.params", "http_param"),
        ("req.headers", "http_header"),
        ("req.cookies", "http_param"),
        ("req.signedCookies", "http_param"),
        ("req.get", "http_header"),
        ("req.param", "http_param"),
        ("ctx.query", "http_param"),
        ("ctx.request.body", "http_body"),
        ("ctx.params", "http_param"),
        ("ctx.headers", "http_header"),
        ("ctx.cookies", "http_param"),
        ("process.env", "env_var"),
        ("process.argv", "http_param"),
        ("Deno.env", "env_var"),
        ("Bun.env", "env_var"),
    ),
    "go": (
        ("r.URL.Query", "http_param"),
        ("r.URL.Query().Get", "http_param"),
        ("r.FormValue", "http_param"),
        ("r.PostFormValue", "http_body"),
        ("r.Form", "http_param"),
        ("r.PostForm", "http_body"),
        ("r.MultipartForm", "http_body"),
        ("r.Header", "http_header"),
        ("r.Header.Get", "http_header"),
        ("r.Header.Values", "http_header"),
        ("r.Cookie", "http_param"),
        ("r.Referer", "http_header"),
        ("r.UserAgent", "http_header"),
        ("r.RemoteAddr", "http_header"),
        ("r.RequestURI", "http_param"),
        ("os.Getenv", "env_var"),
        ("os.Environ", "env_var"),
        ("os.LookupEnv", "env_var"),
        ("ctx.Value", "http_param"),
    ),
}

# Dangerous calls by language, with their kind.
SINKS = {
    "java": (
        ("executeQuery", "sql"),
        ("executeUpdate", "sql"),
        ("execute", "sql"),
        ("createNativeQuery", "sql"),
        ("createQuery", "sql"),
        ("createSQLQuery", "sql"),
        ("nativeQuery", "sql"),
        ("queryForObject", "sql"),
        ("queryForList", "sql"),
        ("exec", "command"),
        ("Runtime.exec", "command"),
        ("ProcessBuilder.start", "command"),
        ("ProcessBuilder.command", "command"),
        ("readObject", "deserialization"),
        ("ObjectInputStream", "deserialization"),
        ("XStream.fromXML", "deserialization"),
        ("Yaml.load", "deserialization"),
        ("JSON.parseObject", "deserialization"),
        ("readValue", "deserialization"),
        ("XMLDecoder.readObject", "deserialization"),
        ("SerializationUtils.deserialize", "deserialization"),
        ("Hessian2Input.readObject", "deserialization"),
        ("sendRedirect", "redirect"),
        ("forward", "redirect"),
        ("eval", "eval"),
        ("ScriptEngine.eval", "eval"),
        ("response.getWriter", "template"),
        ("out.print", "template"),
        ("out.println", "template"),
        ("out.write", "template"),
        ("ModelAndView", "template"),
        ("Velocity.evaluate", "template"),
        ("FileWriter", "file_write"),
        ("FileOutputStream", "file_write"),
    ),
    "python": (
        ("execute", "sql"),
        ("executemany", "sql"),
        ("rawsql", "sql"),
        ("os.system", "command"),
        ("subprocess.Popen", "command"),
        ("subprocess.run", "command"),
        ("subprocess.call", "command"),
        ("subprocess.check_output", "command"),
        ("os.popen", "command"),
        ("os.popen2", "command"),
        ("os.popen3", "command"),
        ("os.popen4", "command"),
        ("pickle.load", "deserialization"),
        ("pickle.loads", "deserialization"),
        ("yaml.load", "deserialization"),
        ("marshal.load", "deserialization"),
        ("shelve.open", "deserialization"),
        ("eval", "eval"),
        ("exec", "eval"),
        ("compile", "eval"),
        ("render", "template"),
        ("render_template", "template"),
        ("render_template_string", "template"),
        ("Template", "template"),
        ("open", "file_write"),
        ("shutil.copy", "file_write"),
        ("shutil.move", "file_write"),
    ),
    "js": (
        ("query", "sql"),
        ("execute", "sql"),
        ("find", "sql"),
        ("findOne", "sql"),
        ("findAll", "sql"),
        ("findOneAndUpdate", "sql"),
        ("exec", "command"),
        ("execSync", "command"),
        ("spawn", "command"),
        ("spawnSync", "command"),
        ("fork", "command"),
        ("execFile", "command"),
        ("execFileSync", "command"),
        ("unserialize", "deserialization"),
        ("deserialize", "deserialization"),
        ("writeFile", "file_write"),
        ("writeFileSync", "file_write"),
        ("appendFile", "file_write"),
        ("render", "template"),
        ("renderFile", "template"),
        ("renderString", "template"),
        ("eval", "eval"),
        ("Function", "eval"),
        ("redirect", "redirect"),
        ("res.redirect", "redirect"),
        ("ctx.redirect", "redirect"),
    ),
    "go": (
        ("Query", "sql"),
        ("QueryRow", "sql"),
        ("Exec", "sql"),
        ("Prepare", "sql"),
        ("Raw", "sql"),
        ("exec.Command", "command"),
        ("exec.CommandContext", "command"),
        ("os.StartProcess", "command"),
        ("json.Unmarshal", "deserialization"),
        ("gob.Decode", "deserialization"),
        ("xml.Unmarshal", "deserialization"),
        ("yaml.Unmarshal", "deserialization"),
        ("os.WriteFile", "file_write"),
        ("os.Create", "file_write"),
        ("ioutil.WriteFile", "file_write"),
        ("http.Redirect", "redirect"),
    ),
}

# Types whose constructors are dangerous, with their kind.
CONSTRUCTOR_SINKS = {
    "java": (
        ("FileWriter", "file_write"),
        ("FileOutputStream", "file_write"),
        ("FileInputStream", "file_write"),
        ("FileReader", "file_write"),
        ("ZipOutputStream", "file_write"),
        ("ObjectInputStream", "deserialization"),
        ("XMLDecoder", "deserialization"),
        ("ProcessBuilder", "command"),
    ),
}

# Calls that make input safe, by language.
SANITIZERS = {
    "java": (
        "Encode.forHtml",
        "Encode.forJavaScript",
        "Encode.forSql",
        "ESAPI.encoder",
        "StringEscapeUtils.escapeHtml",
        "StringEscapeUtils.escapeSql",
        "HtmlUtils.htmlEscape",
        "URLEncoder.encode",
        "URLDecoder.decode",
        "Validator.validate",
        "validate",
        "isValid",
        "sanitize",
        "PreparedStatement",
        "setString",
        "setInt",
        "setParameter",
    ),
    "python": (
        "escape",
        "html.escape",
        "markupsafe.escape",
        "cgi.escape",
        "validate",
        "is_valid",
        "clean",
        "sanitize",
        "sanitize_filename",
        "shlex.quote",
        "pipes.quote",
        "bleach.clean",
        "bleach.linkify",
        "defusedxml",
        "defusedxml.ElementTree",
    ),
    "js": (
        "escape",
        "escapeHtml",
        "xss",
        "sanitize",
        "sanitizeHtml",
        "validator.escape",
        "validator.trim",
        "DOMPurify",
        "shellQuote",
        "shell-quote",
        "validate",
        "isValid",
    ),
    "go": (
        "html.EscapeString",
        "html.UnescapeString",
        "template.HTMLEscapeString",
        "template.JSEscapeString",
        "template.URLQueryEscaper",
        "url.QueryEscape",
        "url.PathEscape",
        "validate",
        "isValid",
        "sanitize",
    ),
}

# Weaknesses that apply to a kind of surface, in order.
APPLICABLE = {
    "external_input": (22, 89, 78, 79, 94, 502, 918),
    "auth_boundary": (862, 89, 78),
    "idor_candidate": (862, 89, 78, 22),
    "dangerous_sink": (327,),
}

# Calls that make a weakness relevant.
ANCHORS = {
    89: (
        "executeQuery",
        "executeUpdate",
        "createNativeQuery",
        "createSQLQuery",
        "Statement.execute",
        "JdbcTemplate.query",
        "JdbcTemplate.update",
        "JdbcTemplate.queryForObject",
        "JdbcTemplate.batchUpdate",
        "cursor.execute",
        "cursor.executemany",
        "cursor.executescript",
        "connection.execute",
        "sqlalchemy.text",
        "RawSQL",
        "db.Query",
        "db.Exec",
        "db.QueryRow",
        "sqlx.Query",
        "sqlx.Exec",
        "gorm.Raw",
        "gorm.Exec",
        "pool.query",
        "connection.query",
        "sequelize.query",
        "knex.raw",
        "createQueryBuilder",
        "manager.query",
    ),
    78: (
        "Runtime.exec",
        "ProcessBuilder.start",
        "subprocess.Popen",
        "subprocess.call",
        "subprocess.run",
        "subprocess.check_output",
        "subprocess.check_call",
        "os.system",
        "os.popen",
        "os.spawnl",
        "os.spawnv",
        "exec.Command",
        "exec.CommandContext",
        "child_process.exec",
        "child_process.execSync",
        "child_process.spawn",
        "child_process.spawnSync",
        "child_process.execFile",
        "child_process.execFileSync",
    ),
    22: (
        "FileWriter",
        "FileOutputStream",
        "FileInputStream",
        "FileReader",
        "new File",
        "Paths.get",
        "Files.copy",
        "Files.write",
        "Files.readAllBytes",
        "Files.newInputStream",
        "ZipEntry",
        "ZipInputStream",
        "getCanonicalPath",
        "getAbsolutePath",
        "transferTo",
        "file.transferTo",
        "OutputStream.write",
        "Files.newOutputStream",
        "Files.newBufferedWriter",
        "Files.createFile",
        "Files.createTempFile",
        "Files.move",
        "os.path.join",
        "pathlib.Path",
        "shutil.copy",
        "shutil.move",
        "shutil.copyfile",
        "zipfile.extract",
        "zipfile.extractall",
        "tarfile.extract",
        "tarfile.extractall",
        "send_file",
        "send_from_directory",
        "os.Open",
        "os.OpenFile",
        "os.Create",
        "os.ReadFile",
        "os.WriteFile",
        "ioutil.ReadFile",
        "ioutil.WriteFile",
        "filepath.Join",
        "http.ServeFile",
        "zip.OpenReader",
        "fs.readFile",
        "fs.readFileSync",
        "fs.writeFile",
        "fs.writeFileSync",
        "fs.createReadStream",
        "fs.createWriteStream",
        "path.join",
        "path.resolve",
        "res.sendFile",
        "unzipper.Extract",
    ),
    79: (
        "PrintWriter.print",
        "HttpServletResponse.print",
        "out.println",
        "response.getWriter",
        "render_template_string",
        "Markup",
        "mark_safe",
        "format_html",
        "template.HTML",
        "template.JS",
        "Fprintf(w",
        "innerHTML",
        "outerHTML",
        "document.write",
        "dangerouslySetInnerHTML",
        "v-html",
        "insertAdjacentHTML",
        "response.write",
        "response.Send",
    ),
    94: (
        "ScriptEngine.eval",
        "Nashorn.eval",
        "JavaCompiler.compile",
        "Compiler.compile",
        "GroovyShell.evaluate",
        "Method.invoke",
        "Constructor.newInstance",
        "eval",
        "compile",
        "__import__",
        "plugin.Open",
        "new Function",
        "vm.runInContext",
        "vm.runInNewContext",
        "vm.runInThisContext",
        "execScript",
    ),
    918: (
        "HTTPClient.send",
        "RestTemplate.getForObject",
        "RestTemplate.postForObject",
        "WebClient.get",
        "URLConnection.openConnection",
        "HttpURLConnection",
        "requests.get",
        "requests.post",
        "requests.request",
        "urllib.request.urlopen",
        "httpx.get",
        "httpx.post",
        "aiohttp.ClientSession",
        "http.Get",
        "http.Post",
        "http.Client",
        "http.NewRequest",
        "axios.get",
        "axios.post",
        "http.request",
        "https.request",
        "node-fetch",
        "fetch",
    ),
    327: (
        "MessageDigest.getInstance",
        "Cipher.getInstance",
        "md5",
        "sha1",
        "des",
        "rc4",
        "hashlib.md5",
        "hashlib.sha1",
        "Crypto.Cipher.DES",
        "Crypto.Cipher.ARC4",
        "crypto/md5",
        "crypto/sha1",
        "crypto/des",
        "crypto/rc4",
        "des.NewCipher",
        "createHash",
        "createCipheriv",
    ),
    502: (
        "ObjectInputStream.readObject",
        "ObjectInputStream.deserialize",
        "XMLDecoder",
        "XStream.fromXML",
        "Deserializer.deserialize",
        "Unmarshaller.unmarshal",
        "XmlUnmarshaller.unmarshal",
        "pickle.load",
        "pickle.loads",
        "yaml.load",
        "marshal.loads",
        "shelve.open",
        "gob.Decode",
        "gob.NewDecoder",
        "node-serialize.unserialize",
        "js-yaml.load",
    ),
}

# Calls that make it safe.
SAFE = {
    89: (
        "PreparedStatement",
        "prepareStatement",
        "bindParams",
        "sqlalchemy.bindparams",
        "paramQuery",
        "parameterizedQuery",
        "boundParam",
        "knex.where",
        "sequelize.findOne",
    ),
    78: (
        "shellEscape",
        "shlex.quote",
        "shlex.split",
        "execFile",
        "commandAllowlist",
        "argSanitize",
    ),
    22: (
        "pathClean",
        "canonicalizePath",
        "pathValidate",
        "baseNameOnly",
        "normalize",
        "toAbsolutePath",
        "startsWith",
        "filepath.Clean",
        "os.path.abspath",
        "secure_filename",
        "sanitizeFilename",
    ),
    79: (
        "htmlEscape",
        "outputEncode",
        "contextEncode",
        "autoEscape",
        "html.EscapeString",
        "template.HTMLEscapeString",
        "bleach.clean",
        "DOMPurify.sanitize",
        "textContent",
    ),
    918: (
        "urlAllowlist",
        "domainCheck",
        "urlValidate",
        "hostnameVerify",
        "isPrivateIP",
        "ssrfReqFilter",
    ),
    327: (
        "crypto.SHA256",
        "crypto.SHA512",
        "cipher.AESGCM",
        "crypto.AES",
        "sha256",
        "sha512",
        "aesGcm",
        "hashlib.sha256",
        "bcrypt",
        "argon2",
        "scrypt",
    ),
    502: (
        "typeFilter",
        "objectFilter",
        "deserializeSecure",
        "validateDeserialize",
        "yaml.safe_load",
        "yaml.SafeLoader",
        "js-yaml.safeLoad",
    ),
}
