"""Code corpus derived from the line items: every line item is one small source file."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.base import table
from auditlake.session import estimated_bytes

STRUCTS = [
    "#[derive(Accounts)]\npub struct Move<'info> {\n    #[account(mut, seeds = [b\"vault_\", user.key().as_ref()], bump)]\n    pub vault: Account<'info, TokenAccount>,\n    #[account(mut)]\n    pub target: Account<'info, TokenAccount>,\n    pub user: Signer<'info>,\n    pub token_program: Program<'info, Token>,\n}\n",
    "#[derive(Accounts)]\npub struct Move<'info> {\n    #[account(mut)]\n    pub source: AccountInfo<'info>,\n    #[account(mut)]\n    pub destination: AccountInfo<'info>,\n    pub authority: AccountInfo<'info>,\n}\n",
    "#[derive(Accounts)]\npub struct Move<'info> {\n    #[account(mut, has_one = authority)]\n    pub pool: Account<'info, Pool>,\n    #[account(mut)]\n    pub pool_b: Account<'info, Pool>,\n    pub authority: UncheckedAccount<'info>,\n    pub payer: Signer<'info>,\n}\n",
    "#[derive(Accounts)]\npub struct Move<'info> {\n    #[account(init, payer = admin, space = 64)]\n    pub config: Account<'info, Config>,\n    /// CHECK: only read\n    pub admin: UncheckedAccount<'info>,\n    pub mint: Account<'info, Mint>,\n}\n",
    "#[derive(Accounts)]\npub struct Move<'info> {\n    #[account(init_if_needed, close = owner)]\n    pub state: Account<'info, State>,\n    pub owner: Signer<'info>,\n    pub oracle: AccountInfo<'info>,\n}\n",
]
FIRST = [
    "    let price = get_price(oracle);", "    invoke(&ix, &[source, destination])?;", "    token::transfer(cpi, amount)?;",
    "    state.balance += amount;", "    let share = amount / total_shares * rate;", "    require!(amount > 0, Bad);",
    "    lamports.borrow_mut();", "    let x = data.try_from_slice(raw);", "    mint_to(cpi, amount)?;", "    set_authority(next);",
    "    for item in items.iter() { total += item; }", "    emit!(Moved { amount });", "    let now = Clock::get()?.unix_timestamp;",
]
SECOND = [
    "    let fee = price * rate;", "    vault.amount = vault.amount - amount;", "    invoke_signed(&ix, accounts, seeds)?;",
    "    account.data.borrow_mut().serialize(out);", "    let small = big as u64 + u128::from(1);", "    ctx.remaining_accounts.iter();",
    "    swap(pool, amount, 0);", "    borrow(collateral, amount);", "    liquidate(position);", "    msg!(\"done\");",
    "    let ok = amount.checked_add(fee).ok_or(Err)?;", "    let (pda, bump) = Pubkey::find_program_address(&[b\"seed\"], id);",
    "    stake.authorize(staker, is_signer);", "    freeze_account(mint);", "    token_account.close_account(owner);",
    "    let v: Vec<u8> = vec![];", "    let slippage = min_amount_out;",
]
THIRD = [
    "    Ok(())", "    return Err(Bad);", "    Ok(amount)", "    if paused { return Err(Halted); }\n    Ok(())", "    proposal.execute_proposal(vote)",
    "    reward.stake(duration, timestamp)", "    delegate.approve(spender)", "    metadata.update(uri, name)", "    unsafe { ptr::read(p) }",
    "    admin = ctx.accounts.next.key();\n    Ok(())", "    pool.deposit(amount);\n    pool.withdraw(amount);\n    Ok(())",
]
NAMES = ["process_move", "deposit", "handle_swap", "initialize", "withdraw", "get_rate", "helper_step"]


def _pick(values, index):
    return F.element_at(F.lit(values), (index + 1).cast("int"))


#: Bytes of line items, as Spark estimates them, whose files make up one task: their texts are some fifty times longer.
TASK_BYTES = 4 << 20


PLACE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _tasks(li) -> int:
    return max(li.sparkSession.sparkContext.defaultParallelism, estimated_bytes(li) // TASK_BYTES + 1)


def code_files(spark, sf):
    """program, file_path, file_name, content - one row per line item."""
    li = table(spark, sf, "lineitem").select(*PLACE)
    return _texts(li.repartition(_tasks(li)))


def files_by_path(spark, sf):
    """code_files, rows of a path in one task: dealt out before texts are made, so that joins by path don't move them."""
    li = table(spark, sf, "lineitem").select(*PLACE)
    return _texts(li.withColumn("_path", _path()).repartition(_tasks(li), "_path"))


def distinct_files(spark, sf):
    """code_files with one row for each path; of rows without a path, one.

    The path names every column a text is made from, so equal paths have equal texts and rows are told apart before a text is made."""
    li = table(spark, sf, "lineitem").select(*PLACE)
    return _texts(li.repartition(_tasks(li)).withColumn("_path", _path()).dropDuplicates(["_path"]))


def distinct_texts(spark, sf):
    """file_path, content of code_files without repeats; only rows without a path are told apart by their texts."""
    li = table(spark, sf, "lineitem").select(*PLACE[:-1], F.col("l_quantity").cast("bigint").alias("l_quantity"))
    named = F.expr(" and ".join(f"{c} is not null" for c in PLACE))
    whole = _texts(li.where(named).repartition(_tasks(li), *PLACE).distinct()).select("file_path", "content")
    return whole.unionByName(_texts(li.where(~named)).select("file_path", "content").distinct())


def _path():
    return F.concat(
        F.lit("programs/P"), F.col("l_suppkey").cast("string"), F.lit("/src/f"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"),
        F.lit("_"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_quantity").cast("bigint").cast("string"), F.lit(".rs"))


def _texts(li):
    part, supp, order, qty = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_quantity").cast("bigint")
    name = _pick(NAMES, (part + supp) % len(NAMES))
    path = F.col("_path") if "_path" in li.columns else _path()
    content = F.concat(
        F.lit("use anchor_lang::prelude::*;\n"), _pick(STRUCTS, (supp + F.col("l_linenumber")) % len(STRUCTS)), F.lit("pub fn "), name,
        F.when(part % 3 == 0, "(source: AccountInfo<'info>, amount: u64) -> Result<()> {\n").otherwise("(ctx: Context<Move>, amount: u64) -> Result<()> {\n"),
        _pick(FIRST, part % len(FIRST)), F.lit("\n"), _pick(SECOND, (part + qty) % len(SECOND)), F.lit("\n"),
        _pick(THIRD, (supp + qty) % len(THIRD)), F.lit("\n}\n"),
        F.when(order % 4 == 0, "fn deposit(amount: u64) -> u64 {\n    return amount * 2\n}\n").otherwise(""))
    return li.select(
        F.concat(F.lit("P"), supp.cast("string")).alias("program"), path.alias("file_path"), F.substring_index(path, "/", -1).alias("file_name"),
        content.alias("content"), part.alias("l_partkey"), supp.alias("l_suppkey"))


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


QTY = "CAST(l_quantity AS BIGINT)"
FILES_SQL = f"""files AS (SELECT 'P' || l_suppkey AS program,
 'programs/P' || l_suppkey || '/src/f' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || {QTY} || '.rs' AS file_path,
 'f' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || {QTY} || '.rs' AS file_name,
 ({_list(NAMES)})[1 + (l_partkey + l_suppkey) % {len(NAMES)}] AS fn_name,
 ({_list(STRUCTS)})[1 + (l_suppkey + l_linenumber) % {len(STRUCTS)}] AS block,
 'pub fn ' || ({_list(NAMES)})[1 + (l_partkey + l_suppkey) % {len(NAMES)}]
 || CASE WHEN l_partkey % 3 = 0 THEN '(source: AccountInfo<''info>, amount: u64) -> Result<()> {{' ELSE '(ctx: Context<Move>, amount: u64) -> Result<()> {{' END || chr(10)
 || ({_list(FIRST)})[1 + l_partkey % {len(FIRST)}] || chr(10) || ({_list(SECOND)})[1 + (l_partkey + {QTY}) % {len(SECOND)}] || chr(10)
 || ({_list(THIRD)})[1 + (l_suppkey + {QTY}) % {len(THIRD)}] || chr(10) || '}}' || chr(10) AS main_fn,
 l_partkey % 3 <> 0 AS has_context, l_orderkey % 4 = 0 AS has_second, l_partkey, l_suppkey FROM lineitem),
 texts AS (SELECT *, 'use anchor_lang::prelude::*;' || chr(10) || block || main_fn
  || CASE WHEN has_second THEN 'fn deposit(amount: u64) -> u64 {{' || chr(10) || '    return amount * 2' || chr(10) || '}}' || chr(10) ELSE '' END AS content FROM files)"""
FILES_SQL = FILES_SQL.replace("\n    ", "\n    ")
UNITS_SQL = FILES_SQL + """, units AS (SELECT program, file_path, file_name, fn_name, CASE WHEN has_context THEN '/* ACCOUNTS_STRUCT: Move */' || chr(10) || block_text || chr(10)
  || '/* HANDLER: */' || chr(10) || main_fn ELSE main_fn END AS code, main_fn AS bare, l_partkey, l_suppkey FROM (SELECT *, rtrim(block, chr(10)) AS block_text FROM texts)
 UNION ALL SELECT program, file_path, file_name, 'deposit', 'fn deposit(amount: u64) -> u64 {' || chr(10) || '    return amount * 2' || chr(10) || '}' || chr(10),
  'fn deposit(amount: u64) -> u64 {' || chr(10) || '    return amount * 2' || chr(10) || '}' || chr(10), l_partkey, l_suppkey FROM texts WHERE has_second)"""


def sql_condition(tree, text, columns=None):
    """DuckDB text of a condition tree."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    if isinstance(tree, str):
        return f"contains({text}, {lit(tree)})"
    kind, *parts = tree
    if kind == "every":
        return "(" + " AND ".join(sql_condition(p, text) for p in parts) + ")"
    if kind == "some":
        return "(" + " OR ".join(sql_condition(p, text) for p in parts) + ")"
    if kind == "none":
        return "NOT (" + " OR ".join(sql_condition(p, text) for p in parts) + ")"
    if kind == "count":
        return f"((length({text}) - length(replace({text}, {lit(parts[0])}, ''))) // {len(parts[0])} >= {parts[1]})"
    if kind == "at_least":
        return "((" + " + ".join(f"CAST({sql_condition(p, text)} AS INTEGER)" for p in parts[1:]) + f") >= {parts[0]})"
    if kind == "regex":
        return f"regexp_matches({text}, {lit(parts[0])})"
    if kind == "line":
        return f"(len(list_filter(string_split({text}, chr(10)), lambda one_line: {sql_condition(parts[0], 'one_line')})) > 0)"
    if kind == "lower":
        return sql_condition(parts[0], f"lower({text})")
    if kind == "within":
        return sql_condition(parts[1], parts[0])
    if kind == "flag":
        return f"coalesce({parts[0]}, FALSE)"
    raise ValueError(kind)
