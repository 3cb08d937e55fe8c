"""Short forms of given names, as people type them: what no corpus tells. A name that is not here is a name all the same."""

from __future__ import annotations

import unicodedata

# Given names of several languages, each with the short forms used for it.
SHORT_FORMS = """
Abigail: Abby, Gail
Agnès: Aggie, Nessie
Alexander: Alex, Sandy, Alec, Sasha
Andrew: Andy, Drew
Anthony: Tony
Barbara: Babs, Barb, Barbie
Beatriz: Bea, Trixie
Benjamin: Ben, Benny
Catherine: Cathy, Kate, Katie, Cat
Christopher: Chris, Kit, Topher
Daniel: Dan, Danny
Deborah: Debbie, Deb
Dorothy: Dolly, Dot, Dottie
Edward: Ed, Eddie, Ned, Ted, Teddy
Elizabeth: Beth, Betty, Liz, Lizzie, Eliza
Emilio: Milo
Frances: Fran, Fanny, Frankie
Frederick: Fred, Freddie
Gertrude: Trudy, Gert, Gertie
Gregory: Greg
Helena: Nell, Lena, Nelly
Henry: Hank, Harry
Ignacio: Nacho
Isabella: Bella, Izzy, Isa
James: Jim, Jimmy, Jamie
Jennifer: Jen, Jenny
José: Pepe
Katarzyna: Kasia
Kenneth: Ken, Kenny
Kimberly: Kim
Lawrence: Larry, Laurie
Leonard: Len, Lenny, Leo
Lucía: Lucy
Małgorzata: Gosia
Margaret: Maggie, Meg, Peggy, Marge
Matthew: Matt
Michael: Mick, Mike, Mickey
Natalia: Natasha, Talia
Nicholas: Nick, Nicky
Olga: Olya
Oliver: Ollie
Patricia: Pat, Trish, Patty, Tricia
Peter: Pete
Rebecca: Becky, Becca
Richard: Dick, Rick, Rich, Ricky
Robert: Bob, Rob, Bobby, Robbie
Samuel: Sam, Sammy
Stephen: Steve, Stevie
Susan: Sue, Suzy, Susie
Thaddeus: Thad, Tad
Theresa: Terry, Tess, Tessa
Thomas: Tom, Tommy
Umberto: Berto
Ursula: Uschi
Victoria: Vicky, Tori
Vladimir: Volodya, Vova
William: Bill, Billy, Will, Willy
Winifred: Winnie
Wojciech: Wojtek
Xavier: Xavi
Zachary: Zach, Zack
Albert: Al, Bert
Alexandra: Alex, Sandra, Sasha
Aleksei: Alyosha
Arthur: Art, Artie
Charles: Charlie, Chuck, Chas
Christine: Chris, Chrissie, Tina
David: Dave, Davy
Dmitri: Dima, Mitya
Donald: Don, Donnie
Douglas: Doug
Ekaterina: Katya
Eleanor: Nell, Ellie, Nora
Eugene: Gene
Francis: Frank, Frankie
Francisco: Paco, Pancho
Friedrich: Fritz
Gabriel: Gabe
Gerald: Gerry, Jerry
Giuseppe: Beppe, Peppe
Harold: Hal, Harry
Heinrich: Heinz
Jacqueline: Jackie
Jeffrey: Jeff
Jessica: Jess, Jessie
Johannes: Hannes, Hans
John: Jack, Johnny
Jonathan: Jon, Jonny
Joseph: Joe, Joey
Josephine: Josie, Jo
Joshua: Josh
Judith: Judy, Jude
Katherine: Kate, Katie, Kathy, Kit
Louis: Lou, Louie
Mary: Molly, Polly, May
Mikhail: Misha
Nathaniel: Nate, Nat
Pamela: Pam
Patrick: Pat, Paddy
Philip: Phil, Pip
Raymond: Ray
Ronald: Ron, Ronnie
Samantha: Sam, Sammy
Sergei: Seryozha
Stanislav: Stas, Slava
Timothy: Tim, Timmy
Veronica: Ronnie, Vera
Vincent: Vince, Vinnie
Virginia: Ginny, Ginger
Walter: Walt, Wally
Wilhelm: Willi
"""

#: Letters that no Unicode decomposition brings to ASCII.
_LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "ı": "i"})


def ascii_fold(s: str) -> str:
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFKD", s.translate(_LETTERS)) if not unicodedata.combining(c))


def _parse() -> dict[str, tuple[str, ...]]:
    full: dict[str, list[str]] = {}
    for line in SHORT_FORMS.strip().splitlines():
        name, _, short = line.partition(":")
        base = ascii_fold(name.strip()).lower()
        for w in [name, *short.split(",")]:
            options = full.setdefault(ascii_fold(w.strip()).lower(), [])
            if base not in options:
                options.append(base)
    return {k: tuple(v) for k, v in full.items()}


#: Folded given name or short form -> folded full names.
FULL_OF = _parse()
